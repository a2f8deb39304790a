"""Mixing sources to target weights by capped water-filling.

Targets. A source of ``size`` words and weight ``w`` gets ``min(cap * size, level * w)`` words; ``level`` is the water
level at which all targets add up to ``share`` times all words. It is found by clamping and sharing again, where a round
is one distributed sum over sources, so there may be very many of them.

Sampling. A source's target is a whole number of epochs plus a part of one more. Every document gets the whole epochs;
the part goes to documents in a seeded order (md5 of seed, id and text) until its words are used up, and the document at
the cut is repeated in part. So a source's taken words equal its rounded target, no document exceeds ``cap`` epochs, and
reruns agree. The order is found without sorting documents: rows fall into 4,096 buckets by md5, bucket sums give the
bucket that holds the cut, and only that bucket's rows are sorted (one bucket per source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, SPACE, WORD, salted_left_join, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a join key that keeps null apart from every string and sorts it last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _order(seed: str) -> Column:
    """The seeded place of a row. It depends on the text too: rows that share an id spread over the buckets, and reruns cut
    the same text. Rows with equal id and text are interchangeable."""
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def with_keys(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source and others) -> with _key, _order and _bucket."""
    return docs.withColumns({"_key": _key(F.col("source")), "_order": _order(seed)}).withColumn("_bucket", F.substring("_order", 1, 3))


def _numbered(sizes: DataFrame) -> DataFrame:
    """Add _rank, the 0-based place of _key in the order of all keys, without a window over all sources.

    Keys are range-partitioned and sorted within; a row's place is its place in its partition plus the rows of the
    partitions before, a table of one row per partition.
    """
    placed = sizes.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_place", F.monotonically_increasing_id())
    placed = written(placed, "mix-places")
    part = F.shiftright("_place", 33)
    parts = placed.groupBy(part.alias("_in")).agg(F.count("*").alias("_n"))
    before = parts.select("_in", F.coalesce(F.sum("_n").over(Window.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_in", part).join(F.broadcast(before), "_in")
    return ranked.withColumn("_rank", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_in", "_place", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sizes (_key, source_size) -> with target, by water-filling over any number of sources.

    Weights repeat over sources in code point order, null last. Every round clamps the sources that the water level has
    passed and shares what is left among the others by weight; the level only rises, and a round is one sum over sources.
    A source without words gets target 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = written(_numbered(sizes).select("_key", "source_size", weight.alias("_w"), (F.lit(float(cap)) * F.col("source_size")).alias("_cap")), "mix-weights")
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        clamped = F.col("_cap") <= F.lit(level) * F.col("_w")
        full, used, free = ranked.agg(F.count_if(clamped), F.sum(F.when(clamped, F.col("_cap"))), F.sum(F.when(~clamped, F.col("_w")))).first()
        if full == before or not free:
            break
        before, level = full, (share * words - (used or 0.0)) / free
    target = F.when(F.lit(not free), F.col("_cap")).otherwise(F.least("_cap", F.lit(level) * F.col("_w")))
    return ranked.select("_key", "source_size", target.alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sized (_key, _bucket, size) -> one row per source: target, whole epochs, words of the last part, cut bucket.

    _before: words of the source in buckets before the cut bucket.
    """
    buckets = sized.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    buckets = written(buckets, "mix-buckets")
    plan = targets(buckets.groupBy("_key").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    rounded = F.round("target").cast("long")
    plan = plan.withColumn("_whole", F.when(F.col("source_size") > 0, F.least(F.lit(cap).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(0))
    plan = plan.withColumn("_part", F.greatest(F.lit(0).cast("long"), rounded - F.col("_whole") * F.col("source_size")))
    running = F.sum("_words").over(Window.partitionBy("_key").orderBy("_bucket"))
    cuts = buckets.withColumn("_upto", running).join(plan.select("_key", "_part"), "_key")
    cuts = cuts.where((F.col("_upto") >= F.col("_part")) & (F.col("_upto") - F.col("_words") < F.col("_part")))
    cuts = cuts.select("_key", F.col("_bucket").alias("_cut"), (F.col("_upto") - F.col("_words")).alias("_before"))
    return written(plan.join(cuts, "_key", "left"), "mix-plan")


def apply_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target, whole (epochs), part (words of one more) to sized rows; their other columns are kept."""
    if plan.count() <= BROADCAST_ROWS:
        rows = sized.join(F.broadcast(plan), "_key", "left")
    else:
        rows = salted_left_join(sized, plan, ["_key"], F.col("_order"))
    at_cut = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    outside = rows.where(~at_cut).withColumn("part", F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("_key").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("_part") - F.col("_before") - (F.sum("size").over(order) - F.col("size"))
    inside = rows.where(at_cut).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    return outside.unionByName(inside).withColumn("whole", F.col("_whole")).drop("_whole", "_part", "_cut", "_before")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source).

    Null and empty texts have size 0 and are taken 0 times. Repeated rows are documents of their own. A null source is a source of its own, after all others. An empty table gives no rows.
    """
    sized = with_keys(docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size"))).select("doc_id", "size", "_key", "_order", "_bucket")
    sized = written(sized, "mix-sizes")
    rows = apply_plan(sized, mix_plan(sized))
    return rows.select("doc_id", "size", "source_size", F.col("target"), (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: docs repeated for whole epochs, and cut to their first words at a source's cut.

    A document cut short has its words joined by single blanks. The columns are those of docs; n_chars, where present,
    follows the text. Documents without words are never taken.
    """
    names = docs.columns
    size = word_count(F.col("text")).alias("size")
    plan = mix_plan(with_keys(docs.select("doc_id", "source", "text", size)).select("_key", "_bucket", "size"))
    # the row travels as one struct, so no column of docs can clash with ours
    packed = docs.select(F.struct(*names).alias("_row"), "doc_id", "source", "text", size)
    rows = apply_plan(with_keys(packed).drop("text"), plan).where(F.col("size") > 0)
    full = F.array_repeat(F.col("size"), (F.col("whole") + (F.col("part") == F.col("size")).cast("long")).cast("int"))
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("_row", "size", F.explode(F.concat(full, cut)).alias("_take"))
    head = F.array_join(F.slice(F.array_remove(F.split("_row.text", SPACE), ""), F.lit(1), F.col("_take").cast("int")), " ")
    rows = rows.withColumn("_text", F.when(F.col("_take") < F.col("size"), head).otherwise(F.col("_row.text")))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in names])


#: The same rows in DuckDB.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY k),
ranked AS (
  SELECT k, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS BIGINT)] AS w,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM sources),
summed AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING) AS caps,
         coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0::DOUBLE) AS rest FROM ranked),
clamped AS (SELECT *, caps + cap / w * rest <= budget AS c FROM summed),
leveled AS (
  SELECT *, (budget - coalesce(sum(cap) FILTER (c) OVER (), 0.0::DOUBLE)) / sum(w) FILTER (NOT c) OVER () AS lvl FROM clamped),
plan AS (SELECT k, source_size, CASE WHEN c THEN cap ELSE least(cap, lvl * w) END AS target FROM leveled),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS whole FROM plan),
parts AS (SELECT *, greatest(0, CAST(round(target) AS BIGINT) - whole * source_size) AS part FROM cut),
run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.part,
         CAST(sum(s.size) OVER (PARTITION BY s.k ORDER BY s.o ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before
  FROM sized s JOIN parts p USING (k))
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken
FROM run
"""
