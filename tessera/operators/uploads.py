"""Multipart upload arithmetic and checks, and the outbox and status rules of the processing pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1024 * 1024
PART_DEFAULT, PART_LEAST, PART_MOST, PARTS_MOST = 16 * MIB, 5 * MIB, 5 * 1024 * MIB, 10_000
TERMINAL = ("READY", "NEEDS_OCR")


def part_plan(files: DataFrame) -> DataFrame:
    """files (file_id, total_size, requested) -> part_size, parts, last_part.

    The requested size (16 MiB by default) is held between 5 MiB and 5 GiB and grown to whole MiB so that parts stay
    within 10,000.
    """
    asked = F.greatest(F.lit(PART_LEAST), F.least(F.lit(PART_MOST), F.coalesce("requested", F.lit(PART_DEFAULT))))
    least = F.ceil(F.col("total_size") / F.lit(PARTS_MOST * MIB)) * MIB
    size = F.greatest(asked, least).cast("long")
    rows = files.withColumn("part_size", size).withColumn("parts", F.ceil(F.col("total_size") / F.col("part_size")).cast("long"))
    return rows.withColumn("last_part", F.col("total_size") - (F.col("parts") - 1) * F.col("part_size")).select("file_id", "total_size", "part_size", "parts", "last_part")


def part_check(plan: DataFrame, parts: DataFrame) -> DataFrame:
    """Per file: uploaded parts and bytes, progress, the first missing part (null if none), wrong sizes, complete."""
    order = Window.partitionBy("file_id").orderBy("part_number")
    numbered = parts.join(plan, "file_id").withColumn("_n", F.row_number().over(order))
    want = F.when(F.col("part_number") == F.col("parts"), F.col("last_part")).otherwise(F.col("part_size"))
    got = numbered.groupBy("file_id").agg(
        F.count("*").alias("uploaded"),
        F.sum("size").cast("long").alias("bytes"),
        F.min(F.when(F.col("_n") != F.col("part_number"), F.col("_n"))).cast("long").alias("_gap"),
        F.sum((F.col("size") != want).cast("long")).alias("wrong_sizes"),
    )
    rows = plan.join(got, "file_id", "left").na.fill(0, ["uploaded", "bytes", "wrong_sizes"])
    missing = F.coalesce("_gap", F.when(F.col("uploaded") < F.col("parts"), F.col("uploaded") + 1))
    rows = rows.withColumn("first_missing", missing).withColumn("progress", F.round(F.col("uploaded") * 100.0 / F.col("parts"), 2))
    done = F.col("first_missing").isNull() & (F.col("wrong_sizes") == 0) & (F.col("bytes") == F.col("total_size"))
    return rows.select("file_id", "uploaded", "bytes", "progress", "first_missing", "wrong_sizes", done.alias("complete"))


def missing_parts(plan: DataFrame, parts: DataFrame) -> DataFrame:
    got = parts.groupBy("file_id").agg(F.collect_set("part_number").alias("_got"))
    every = F.sequence(F.lit(1).cast("long"), F.col("parts"))
    return plan.join(got, "file_id", "left").select("file_id", F.explode(F.array_except(every, F.coalesce("_got", F.array().cast("array<bigint>")))).alias("part_number"))


def outbox_rows(files: DataFrame, kind: str = "DOCUMENT_PROCESSING") -> DataFrame:
    """One event per file and type: dedup_key is TYPE:file:v1."""
    key = F.concat(F.lit(f"{kind}:"), F.col("file_id").cast("string"), F.lit(":v1"))
    return files.withColumn("dedup_key", key).groupBy("dedup_key").agg(F.min("file_id").alias("file_id"))


def dispatchable(status: Column, due: Column, locked_until: Column, now: Column) -> Column:
    pending = (status == "PENDING") & (due.isNull() | (due <= now))
    return pending | ((status == "PUBLISHING") & (locked_until < now))


def claim(events: DataFrame, now: Column, batch: int) -> DataFrame:
    """The oldest dispatchable events, at most batch."""
    rows = events.where(dispatchable(F.col("status"), F.col("next_retry_at"), F.col("locked_until"), now))
    return rows.orderBy("created_at", "event_id").limit(batch)


def dispatch_action(file_status: Column) -> Column:
    """What to do with a claimed event: no file, already handled, or to be sent."""
    return F.when(file_status.isNull(), "DEAD").when(file_status != "UPLOADED", "PUBLISHED").otherwise("SEND")


def retry_outcome(retries: Column, retryable: Column, most: int) -> Column:
    return F.when(~retryable | (retries + 1 >= most), "DEAD").otherwise("PENDING")


def is_retryable(kind: Column, http: Column) -> Column:
    """Connection failures, 429 and 5xx can be tried again; bad arguments, missing objects and other 4xx cannot."""
    return F.when(kind.isin("bad_argument", "missing_object", "access_denied"), False).when(http.isNull(), True).otherwise((http == 429) | (http >= 500) | (http < 400))


def resume_action(status: Column, chunker_version: Column, has_chunks: Column, current: str) -> Column:
    """Ignore finished files; go on from stored chunks of the same chunker; else start over."""
    reuse = status.isin("CHUNKED", "EMBEDDING", "RETRYING") & has_chunks & (chunker_version == current)
    return F.when(status.isin(*TERMINAL), "IGNORE").when(reuse, "VECTORIZE").otherwise("PARSE")


def final_status(events: DataFrame) -> DataFrame:
    """events (file_id, at, event_id, status) -> last status; a failure or retry after a terminal status does not count."""
    order = Window.partitionBy("file_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    settled = F.max(F.col("status").isin(*TERMINAL).cast("int")).over(order)
    late = (F.coalesce(settled, F.lit(0)) == 1) & F.col("status").isin("FAILED", "RETRYING")
    rows = events.withColumn("_late", late)
    return rows.groupBy("file_id").agg(F.max_by("status", F.when(~F.col("_late"), F.struct("at", "event_id"))).alias("status"), F.sum(F.col("_late").cast("long")).alias("late_failures"))


def uploaded_view(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files with the name of their tag, or the tag itself where it has none."""
    return files.join(tags.select(F.col("tag_id").alias("org_tag"), F.col("name").alias("_name")), "org_tag", "left").withColumn("org_tag_name", F.coalesce("_name", "org_tag")).drop("_name")


def without_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table (with file_id) without the rows of the files in gone (file_id): files, sections, chunks and index."""
    ids = gone.select("file_id").distinct()
    return {name: rows.join(ids, "file_id", "left_anti") for name, rows in tables.items()}


def to_reindex(files: DataFrame) -> DataFrame:
    """Files whose upload is complete: the input of a full re-index."""
    return files.where(F.col("status") == 1)


UNKNOWN_ERROR = "未知投递错误"
ERROR_CHARS = 2000


def leased(claimed: DataFrame, lease_s: int, now: Column) -> DataFrame:
    """claimed events (event_id, ...) as PUBLISHING under a new token until the lease ends."""
    return claimed.withColumns({"status": F.lit("PUBLISHING"), "lock_token": F.uuid(), "locked_until": now + F.make_dt_interval(secs=F.lit(lease_s))})


def settle(events: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Events (event_id, status, lock_token, locked_until, retry_count, next_retry_at, last_error) after outcomes (event_id,
    lock_token, action, retry_count, next_retry_at, error) of those who held them.

    action is PUBLISHED, RESCHEDULE or DEAD. An outcome counts only while its event is PUBLISHING under the very token it
    names: whoever lost the lease changes nothing. Of several outcomes under one token the first in order of action counts.
    Every settled event is unlocked; errors are cut to ERROR_CHARS characters, and blank ones get a default. settled tells.
    """
    first = outcomes.groupBy("event_id", "lock_token").agg(F.min(F.struct("action", F.col("retry_count").alias("n"), F.col("next_retry_at").alias("due"), "error")).alias("_o"))
    rows = events.join(first.select(F.col("event_id").alias("_id"), F.col("lock_token").alias("_token"), "_o"), (F.col("event_id") == F.col("_id")) & (F.col("lock_token") == F.col("_token")), "left")
    done = F.col("_o").isNotNull() & (F.col("status") == "PUBLISHING")
    action = F.col("_o.action")
    error = F.when(F.trim(F.coalesce("_o.error", F.lit(""))) == "", UNKNOWN_ERROR).otherwise(F.substring("_o.error", 1, ERROR_CHARS))
    failed = done & (action != "PUBLISHED")
    return rows.withColumns({
        "settled": done,
        "status": F.when(~done, F.col("status")).when(action == "RESCHEDULE", "PENDING").otherwise(action),
        "retry_count": F.when(failed, F.col("_o.n")).otherwise(F.col("retry_count")),
        "next_retry_at": F.when(done & (action == "RESCHEDULE"), F.col("_o.due")).otherwise(F.col("next_retry_at")),
        "last_error": F.when(failed, error).when(done, F.lit(None)).otherwise(F.col("last_error")),
        "published_at": F.when(done & (action == "PUBLISHED"), now),
        "locked_until": F.when(done, F.lit(None)).otherwise(F.col("locked_until")),
        "lock_token": F.when(done, F.lit(None)).otherwise(F.col("lock_token")),
    }).drop("_id", "_token", "_o")


def session_states(events: DataFrame) -> DataFrame:
    """Multipart sessions folded from their events (file_id, at, event_id, action) -> (file_id, status, restarts, refused).

    init opens a session, resumes an open one, and restarts an aborted one; complete and abort need an open one, and what is
    completed stays so: later events change nothing, completing again is answered alike. Events that a state does not allow
    are counted as refused. An event only depends on the state before it, which the last effective event names, so a
    session is one fold over its own few events.
    """
    state = "named_struct('status', cast(null as string), 'restarts', 0L, 'refused', 0L)"
    step = """(s, e) -> CASE
      WHEN s.status = 'COMPLETED' THEN named_struct('status', s.status, 'restarts', s.restarts, 'refused', s.refused + if(e.action = 'abort', 1L, 0L))
      WHEN e.action = 'init' THEN named_struct('status', 'UPLOADING', 'restarts', s.restarts + if(s.status = 'ABORTED', 1L, 0L), 'refused', s.refused)
      WHEN s.status = 'UPLOADING' AND e.action IN ('complete', 'abort') THEN named_struct('status', if(e.action = 'complete', 'COMPLETED', 'ABORTED'), 'restarts', s.restarts, 'refused', s.refused)
      ELSE named_struct('status', s.status, 'restarts', s.restarts, 'refused', s.refused + 1L) END"""
    lists = events.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "action"))).alias("_events"))
    return lists.select("file_id", F.expr(f"aggregate(_events, {state}, {step})").alias("_s")).select("file_id", "_s.*")


def live(rows: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows whose time is not older than a time to live."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(secs=F.lit(seconds)))


def slow_requests(requests: DataFrame, limit_ms: int = 3000) -> DataFrame:
    """requests (path, took_ms) -> per path: requests, slow ones, mean and longest time."""
    took = F.col("took_ms")
    return requests.groupBy("path").agg(F.count("*").alias("requests"), F.count_if(took > limit_ms).alias("slow"), F.round(F.avg(took), 6).alias("mean_ms"), F.max(took).alias("longest_ms"))
