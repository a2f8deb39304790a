"""Quality rules with robust multivariate outliers, in DataFrame and SQL functions only.

Base rules: fewer than MIN_WORDS words, or over half of the words in repeated three-word windows.

Verdict for the rest: four statistics of a document (log of mean word length, log of symbols per word, share of repeated
lines, share of words in repeated windows) are compared with a minimum-covariance-determinant estimate for its language
and source. The estimate starts from quartiles and from classical moments; each concentration step takes the three
quarters of a group nearest to the last centre and computes their mean and covariance. A start of a group ends at its first
step that doesn't lower its determinant by more than one in a thousand, whatever other groups do, and then takes no part in
further steps; the lower of its last two determinants counts, and the start with the smaller one is used. So every step of
every start but its last lowers a determinant that FLOORS bound from below, and the steps end, with ties and approximate
quantiles too. A document is rejected if its squared Mahalanobis distance exceeds CUTOFF.

The statistics have exact values (no repeated lines, no symbols) in most documents, so a group's covariance may be
singular; FLOORS are standard deviations added to it, the spread that is always allowed.

Groups of fewer than MIN_GROUP rows use the estimate of their language, and languages of fewer rows that of all rows;
these are fitted on every passing row of the language or table, those of large groups too.
Every group is reduced by partial aggregation, so a hot source costs no task more than its share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, lookup, written

MIN_WORDS = 50
MIN_GROUP = 50
#: Concentration of a start ends when its determinant doesn't fall by this factor.
SETTLED = 1.001
NEAR = 0.75
#: 0.75 over the probability that a chi-square of 6 degrees is below the 0.75 quantile of 4 degrees: makes the covariance
#: of the nearest three quarters consistent for normal data.
CONSISTENT = 1.485
#: The chi-square quantile of 4 degrees at 1 - 5e-6.
CUTOFF = 30.0
FLOORS = (0.06, 0.05, 0.1, 0.1)
D = len(FLOORS)


def _let(value: Column, body) -> Column:
    """body applied to value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words of a list that stand in a three-word window which occurs twice or more in the list."""

    def covered(hashes: Column) -> Column:
        def neighbours(pairs: Column) -> Column:
            same = lambda x, j: (x["h"] == F.get(pairs, j + 1)["h"]) | (x["h"] == F.get(pairs, j - 1)["h"])
            at = F.sort_array(F.transform(F.filter(pairs, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
            steps = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(x - F.get(p, j - 1), F.lit(3)))), F.lit(0), lambda a, b: a + b)
            return _let(at, steps)

        exact = _let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), neighbours)
        # most texts repeat nothing: they need the distinct count only
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(exact)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(windows, covered))


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs (text and any others) -> with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed.

    Null texts count as empty. Windows are compared by a 64-bit hash of their words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    counted = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lined = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.withColumns({"_c": counted, "_l": lined, "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    rows = rows.withColumns({c: F.col(f"_c.{c}") for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(f"_l.{c}") for c in ("n_dup_lines", "n_lines")}).drop("_c", "_l")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x1": F.log1p(F.col("n_symbols") / n),
        "x2": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x3": F.col("n_repeat_words") / n,
    }


def _keyed(rows: DataFrame) -> DataFrame:
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("?"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("?"))
    return rows.withColumns({"_lang": lang, "_source": source} | _vector())


def _label(kind: str, *keys: str) -> Column:
    return F.concat_ws("\n", F.lit(kind), *keys)


def _groups(rows: DataFrame) -> DataFrame:
    """(_lang, _source) -> _g, the group whose estimate applies, and the groups that the pair's rows are fitted in.

    Those are _own, the pair itself; _by_lang, its language, if a pair of the language is small; _by_all, the table, if a
    language is small.
    """
    pairs = rows.groupBy("_lang", "_source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("_n"))
    by_lang = pairs.groupBy("_lang").agg(F.sum("_n").alias("_m"), F.min("_n").alias("_least"))
    by_all = by_lang.agg((F.min("_m") < MIN_GROUP).alias("_by_all"))
    own, lang = F.col("_n") >= MIN_GROUP, F.col("_m") >= MIN_GROUP
    g = F.when(own, _label("pair", "_lang", "_source")).when(lang, _label("lang", "_lang")).otherwise(_label("all"))
    found = pairs.join(by_lang, "_lang").crossJoin(F.broadcast(by_all))
    return written(found.select("_lang", "_source", g.alias("_g"), own.alias("_own"), (lang & (F.col("_least") < MIN_GROUP)).alias("_by_lang"), "_by_all"), "quality-groups")


def _fitted(passing: DataFrame, groups: DataFrame) -> DataFrame:
    """passing (_lang, _source, x0..x3) -> _g, x0..x3: each row once in every group that it is fitted in."""
    found = lookup(passing, groups.drop("_g"), ["_lang", "_source"], F.xxhash64("n_words", "word_chars"))
    labels = F.array(F.when(F.col("_own"), _label("pair", "_lang", "_source")), F.when(F.col("_by_lang"), _label("lang", "_lang")), F.when(F.col("_by_all"), _label("all")))
    return found.select(F.explode(F.array_compact(labels)).alias("_g"), *[f"x{i}" for i in range(D)])


def _whitening(params: DataFrame) -> DataFrame:
    """(keys, m*, c_ij) -> with w_ij, the inverse Cholesky factor of the covariance, and _det, its determinant."""
    rows = params
    keep = [c for c in params.columns if not c.startswith("c_")]
    for i in range(D):
        for j in range(i + 1):
            left = F.col(f"c_{i}{j}")
            for k in range(j):
                left = left - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            rows = rows.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[i] ** 2 / 100))) if i == j else left / F.col(f"l_{j}{j}"))
    for j in range(D):
        for i in range(j, D):
            if i == j:
                rows = rows.withColumn(f"w_{i}{j}", 1 / F.col(f"l_{i}{i}"))
            else:
                total = sum((F.col(f"l_{i}{k}") * F.col(f"w_{k}{j}") for k in range(j, i)), F.lit(0.0))
                rows = rows.withColumn(f"w_{i}{j}", -total / F.col(f"l_{i}{i}"))
    det = F.lit(1.0)
    for i in range(D):
        det = det * F.col(f"l_{i}{i}") * F.col(f"l_{i}{i}")
    weights = [f"w_{i}{j}" for i in range(D) for j in range(i + 1)]
    return rows.select(*keep, *weights, det.alias("_det"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(D):
        y = sum((F.col(f"w_{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    return total


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    pairs = [(i, j) for i in range(D) for j in range(i + 1)]
    cov = [(F.lit(scale) * F.covar_pop(f"x{i}", f"x{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c_{i}{j}") for i, j in pairs]
    return rows.groupBy("_g", "_start").agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(D)], *cov)


def estimates(rows: DataFrame) -> DataFrame:
    """rows (_g, x0..x3) -> one row per group: centre m*, whitening w_*, _det, by minimum covariance determinant."""
    starts = rows.select("_g", *[f"x{i}" for i in range(D)])
    # start 0: medians and quartile ranges, start 1: classical moments
    quartiles = starts.groupBy("_g").agg(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(D)])
    spread = lambda i: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2
    first = quartiles.select("_g", F.lit(0).alias("_start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(D)], *[(spread(i) if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i in range(D) for j in range(i + 1)])
    params = first.unionByName(_moments(starts.withColumn("_start", F.lit(1)), 1.0))
    params = written(_whitening(params), "quality-start")
    doubled = starts.withColumn("_start", F.explode(F.array(F.lit(0), F.lit(1))))
    spread_by = F.xxhash64("x0", "x1", "x3")

    def concentrated(params: DataFrame) -> DataFrame:
        # rows of starts that have ended find no parameters
        near = lookup(doubled, params, ["_g", "_start"], spread_by).where("_det is not null").withColumn("_d", _distance()).select("_g", "_start", "_d", *[f"x{i}" for i in range(D)])
        limit = written(near.groupBy("_g", "_start").agg(F.percentile_approx("_d", NEAR, 1000).alias("_limit")), "quality-limit")
        inside = lookup(near, limit, ["_g", "_start"], spread_by).where("_d <= _limit")
        return written(_whitening(_moments(inside, CONSISTENT)), "quality-step")

    active, ended = concentrated(params), []
    fields = [c for c in active.columns if c not in ("_g", "_start")]
    while not active.isEmpty():
        now = concentrated(active)
        both = active.select("_g", "_start", F.struct(*fields).alias("_was")).join(now.select("_g", "_start", F.struct(*fields).alias("_now")), ["_g", "_start"])
        falls = F.col("_was._det") / F.col("_now._det") >= SETTLED
        step = written(both.select("_g", "_start", F.coalesce(falls, F.lit(False)).alias("_falls"), F.when(F.col("_now._det") <= F.col("_was._det"), F.col("_now")).otherwise(F.col("_was")).alias("_p")), "quality-fall")
        ended.append(step.where("not _falls").select("_g", "_start", "_p.*"))
        active = step.where("_falls").select("_g", "_start", "_p.*")
    params = reduce(DataFrame.unionByName, ended, active)
    best = params.groupBy("_g").agg(F.min_by("_start", F.struct("_det", "_start")).alias("_start"))
    return written(params.join(best, ["_g", "_start"]).drop("_start"), "quality-estimates")


def _judged(rows: DataFrame, groups: DataFrame, params: DataFrame) -> DataFrame:
    """rows with statistics and keys -> with mahalanobis (null where no estimate applies) and kept."""
    spread_by = F.xxhash64("n_words", "word_chars", "n_repeat_words")
    found = lookup(lookup(rows, groups.select("_lang", "_source", "_g"), ["_lang", "_source"], spread_by), params, ["_g"], spread_by)
    found = found.withColumn("mahalanobis", F.when(F.col("n_words") > 0, _distance()))
    return found.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("mahalanobis"), F.lit(0.0)) <= CUTOFF))


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed"]


def _fit(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    slim = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    rows = _keyed(written(base_statistics(docs.select(*slim, "text")).select(*slim, *STATISTICS), "quality-statistics"))
    groups = _groups(rows)
    return rows, groups, estimates(_fitted(rows.where(~F.col("base_failed")), groups))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): statistics, base_failed, mahalanobis, kept.

    Null texts count as empty and fail. A null language or source is a value of its own. Repeated rows are judged each.
    Where no document passes the base rules there is no estimate, and nothing is kept. An empty table gives no rows.
    """
    rows, groups, params = _fit(docs)
    return _judged(rows, groups, params).select("doc_id", *[c for c in STATISTICS if c != "n_lines"], "mahalanobis", "kept")


#: The base columns of judge in DuckDB.
BASE_SQL = r"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
numbered AS (SELECT row_number() OVER () AS r, * FROM worded),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM numbered)),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS twice FROM windows),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM counted WHERE twice) GROUP BY r),
rows AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM numbered LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
FROM rows
"""


def kept_documents(docs: DataFrame) -> DataFrame:
    """Rows of docs that the rules keep, with the columns of docs.

    The estimates are small, so the second pass computes the statistics of a text again beside the text: no text is
    shuffled, and ids need not be unique.
    """
    _, groups, params = _fit(docs)
    names = docs.columns
    packed = docs.select(F.struct(*names).alias("_row"), "text", "lang", "source")
    return _judged(_keyed(base_statistics(packed)), groups, params).where("kept").select("_row.*")
