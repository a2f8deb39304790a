"""Conversation windows, prompt contexts and citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

HISTORY_TOKENS = 2500
REWRITE_TURNS = 3
ROLES = ("user", "assistant")


def _valid(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) with a stripped text that is not blank."""
    rows = messages.where(F.col("role").isin(*ROLES) & F.col("text").isNotNull())
    return rows.withColumn("content", T.strip(T.strip_citations(F.col("text")))).where("content <> ''")


def history_for_answer(messages: DataFrame, budget: int = HISTORY_TOKENS) -> DataFrame:
    """The newest messages that fit the budget: every message costs something, so a running sum from the end decides."""
    rows = _valid(messages).withColumn("tokens", T.history_token_estimate(F.col("content")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= budget).select("conv_id", "turn", "role", "content", "tokens", "used")


def history_for_rewrite(messages: DataFrame, turns: int = REWRITE_TURNS) -> DataFrame:
    """Valid messages among the last 2 * turns messages; the window comes first, then the filter."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * max(1, turns))
    return _valid(last).select("conv_id", "turn", "role", "content")


def keep_last(messages: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return messages.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(2, most)).drop("_r")


def append_turn(messages: DataFrame, turns: DataFrame, most: int) -> DataFrame:
    """Messages with one user and one assistant row per row of turns (conv_id, question, answer), then trimmed."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    new = turns.join(last, "conv_id", "left").withColumn("_at", F.coalesce("_last", F.lit(-1).cast("long")))
    rows = new.select("conv_id", F.inline(F.array(F.struct((F.col("_at") + 1).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct((F.col("_at") + 2).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))))
    return keep_last(messages.select("conv_id", "turn", "role", "text").unionByName(rows), most)


def session_titles(messages: DataFrame) -> DataFrame:
    """(conv_id, title) from the first user message; a conversation without one has the default title."""
    firsts = messages.groupBy("conv_id").agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("_t"))
    return firsts.select("conv_id", T.session_title(F.col("_t")).alias("title"))


def prompt_context(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, file_name, title_path, page_start, page_end, source_label, text) -> one prompt per query,
    with numbered source blocks in rank order. A prompt holds the few hits of a query."""
    line = lambda label, value: F.when(T.blank_to_null(value).isNotNull(), F.concat(F.lit(label + "："), value, F.lit("\n"))).otherwise("")
    number = F.col("rank").cast("string")
    label = F.coalesce(T.blank_to_null(F.col("source_label")), T.blank_to_null(F.col("file_name")), F.lit(T.UNKNOWN_SOURCE))
    block = F.concat(
        F.lit("[来源#"), number, F.lit("]\n来源："), label, F.lit("\n"),
        line("文件", F.col("file_name")), line("标题路径", F.col("title_path")), line("页码", T.page_label(F.col("page_start"), F.col("page_end"))),
        F.lit("正文：\n"), T.strip(F.coalesce(F.col("text"), F.lit(""))), F.lit("\n[/来源#"), number, F.lit("]\n\n"),
    )
    blocks = hits.select("query_id", "rank", block.alias("_b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_b"))), lambda x: x["_b"]), "")
    return blocks.groupBy("query_id").agg(joined.alias("prompt"), F.count("*").alias("sources"))


def validate_citations(answers: DataFrame) -> DataFrame:
    """answers (answer, source_ids) -> with cited, invalid, has_citation, all_valid."""
    rows = answers.withColumn("cited", T.citation_ids(F.col("answer")))
    rows = rows.withColumn("invalid", F.array_except("cited", F.coalesce("source_ids", F.array().cast("array<int>"))))
    return rows.withColumns({"has_citation": F.size("cited") > 0, "all_valid": F.size("invalid") == 0})


def messages_of(rules: str, history: DataFrame, contexts: DataFrame) -> DataFrame:
    """contexts (query_id, conv_id, prompt, question) -> messages: rules, history, sources, question."""
    past = history.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("_past"))
    joined = contexts.join(past, "conv_id", "left")
    one = lambda role, body: F.array(F.struct(F.lit(role).alias("role"), body.alias("content")))
    empty = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    return joined.select("query_id", F.concat(one("system", F.lit(rules)), F.coalesce("_past", empty), one("system", F.col("prompt")), one("user", F.col("question"))).alias("messages"))


def owned_sessions(index: DataFrame, metas: DataFrame, most: int = 100) -> DataFrame:
    """index (user_id, conv_id, updated), metas (conv_id, owner_id, title) -> the newest sessions of each user.

    Entries among the newest ``most`` whose session is gone or belongs to somebody else are left out, not replaced.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("updated"), F.desc("conv_id"))
    newest = index.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
    return newest.join(metas, "conv_id").where(F.col("owner_id") == F.col("user_id")).select("user_id", "conv_id", "title", "updated")


def rewritten(questions: DataFrame, rewriter: Callable[[Column, Column], Column] | None) -> DataFrame:
    """questions (question, history) -> with query, and rewritten: whether it is another than the question.

    Only questions that need context and have a history go to the rewriter, a Column function of both (a Pandas function
    around a model, which gives null where the model fails or is late). A null or blank answer, quotes around it aside,
    falls back to the question.
    """
    own = T.strip(F.coalesce("question", F.lit("")))
    asks = T.needs_context(F.col("question")) & (F.size(F.coalesce("history", F.array().cast("array<string>"))) > 0)
    answer = F.lit(None).cast("string") if rewriter is None else F.when(asks, T.blank_to_null(T.unquote(rewriter(F.col("question"), F.col("history")))))
    rows = questions.withColumn("query", F.coalesce(answer, own))
    return rows.withColumn("rewritten", F.col("query") != own)


def sessions(events: DataFrame, most: int = 100) -> DataFrame:
    """events (user_id, session_id, at, action) -> a user's newest sessions (user_id, session_id, created, updated).

    create, touch and delete may come in any number; a session is there if it was created and not deleted afterwards, and
    it is as new as its last create or touch.
    """
    last = lambda *kinds: F.max(F.when(F.col("action").isin(*kinds), F.col("at")))
    rows = events.groupBy("user_id", "session_id").agg(F.min(F.when(F.col("action") == "create", F.col("at"))).alias("created"), last("create", "touch").alias("updated"), last("create").alias("_made"), last("delete").alias("_gone"))
    there = rows.where(F.col("created").isNotNull() & (F.col("_gone").isNull() | (F.col("_gone") < F.col("_made"))))
    order = Window.partitionBy("user_id").orderBy(F.col("updated").desc(), "session_id")
    return there.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("user_id", "session_id", "created", "updated")
