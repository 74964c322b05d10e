"""Quality rules with adaptive thresholds. DataFrame functions only.

Every document gets a few integer metrics. Their distribution per language and source is kept as a log-linear quantile
sketch: counts by bucket, whose width is a 64th of the value, so that quantiles are off by under 2 % and sketches merge
by adding counts, in any order, with the same result. Thresholds come from the sketches alone: there are no fixed cutoffs
beside them. The documents are joined with the thresholds of their group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, join_small, null_key, table, word_count

WINDOW = 5
#: The metrics that get adaptive thresholds, and on which sides.
METRICS = {"symbols_pm": "max", "dup_lines_pm": "max", "repeats_pm": "max", "word_len_c": "both"}
#: A group's quantiles are means of its own, its language's and all documents': the latter two weigh as many documents each.
POOL = 50
#: Hundredths that are read from a sketch.
QUANTILES = (1, 10, 90, 99)


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, from whole texts; null counts as empty.

    The rows need no exchange: windows found twice in one text are found by sorting that text's window hashes.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    words = F.filter(F.split(t, SPACE, -1), lambda x: x != "")
    base = docs.withColumns({
        "n_words": word_count(t),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "__h": F.transform(words, lambda w: F.xxhash64(w)),
    })
    shifted = F.col("__h")
    for k in range(1, WINDOW):  # xxhash64 of the words' hashes, chained: a window's hash, without building its text
        shifted = F.zip_with(F.slice("__h", F.lit(1), F.greatest(F.size("__h") - k, F.lit(0))), F.slice(shifted, F.lit(2), F.greatest(F.size("__h") - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    base = base.withColumn("__w", F.when(F.size("__h") >= WINDOW, shifted).otherwise(F.expr("array()").cast("array<bigint>")))
    at = F.array_sort(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("__at", F.when(F.size(F.array_distinct("__w")) < F.size("__w"), at))
    same = F.filter("__at", lambda x, i: (x["h"] == F.get("__at", i - 1)["h"]) | (x["h"] == F.get("__at", i + 1)["h"]))
    base = base.withColumn("__same", F.array_sort(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(F.zip_with("__same", F.slice("__same", 2, F.greatest(F.size("__same") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__w", "__at", "__same")


def bucket(v: Column) -> Column:
    """The sketch's bucket of a non-negative integer: exact below 128, then 64 to each doubling."""
    e = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return (e * 64 + F.call_function("shiftright", v, e)).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest integer in a bucket."""
    e = F.greatest(F.floor((b - 64) / 64), F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - e * 64 + 1).cast("long"), e) - 1


def rates(m: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return m.withColumns({
        "symbols_pm": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "dup_lines_pm": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeats_pm": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "word_len_c": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }).withColumn("n_words", words * 0 + F.col("n_words"))


def sketches(m: DataFrame) -> DataFrame:
    """``lang_key, source_key, metric, bucket, n``: add up ``n`` to merge."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(F.col(k)).alias("bucket")) for k in METRICS]))
    return m.select("lang_key", "source_key", pairs.alias("p")).groupBy("lang_key", "source_key", "p.metric", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group and metric: ``docs`` and a ``q`` for each of :data:`QUANTILES`, read from the merged sketch."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    run = merged.withColumns({"up": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)})
    at = lambda k: F.min(F.when(F.col("up") * 100 >= F.col("docs") * k, F.col("bucket")))
    return run.groupBy(*by, "metric").agg(F.max("docs").alias("docs"), *[bucket_top(at(k)).alias(f"q{k}") for k in QUANTILES])


def thresholds(sketch: DataFrame) -> DataFrame:
    """Per language and source, the columns ``max_<metric>`` and ``min_<metric>``.

    The body of a group's values lies between its quantiles at 10 and 90 %. Allowed is what is above that by three times its
    width at most, or, where the body has less width than the tail, by three quarters of what is between 90 and 99 %; and the same
    below. Quantiles are pooled (:data:`POOL`), so a small group's move smoothly to its own as it grows.
    """
    own = quantiles(sketch, ["lang_key", "source_key"])
    for by, name in ((["lang_key", "metric"], "lang"), (["metric"], "every")):
        level = quantiles(sketch, by[:-1])
        own = own.join(level.select(*by, F.struct(*[f"q{k}" for k in QUANTILES]).alias(name)), by)
    for k in QUANTILES:
        own = own.withColumn(f"q{k}", F.expr(f"(docs * q{k} + {POOL} * lang.q{k} + {POOL} * every.q{k}) div (docs + {2 * POOL})"))
    limits = own.withColumns({"max": F.expr("q90 + 3 * greatest(4 * (q90 - q10), q99 - q90) div 4"), "min": F.expr("q10 - 3 * greatest(4 * (q90 - q10), q10 - q1) div 4")})
    sides = [(k, side) for k, which in METRICS.items() for side in ("max", "min") if which in (side, "both")]
    return limits.groupBy("lang_key", "source_key").agg(*[F.max(F.when(F.col("metric") == k, F.col(side))).alias(f"{side}_{k}") for k, side in sides])


def judge(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, lang, source)`` with metrics, ``base_failed`` and ``kept``, one row per row.

    ``base_failed``: under 10 words, or over 20 % of the words in repeated 5-word windows. ``kept``: not base_failed and
    no metric outside its group's thresholds, which are those of all rows of the group that are not base_failed. Null languages and sources are groups of their own; null, empty and
    blank texts have no words and fail. Repeated rows get one verdict each. No rows in, no rows out.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_lines = F.size(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))).cast("long")
    keyed = docs.select("doc_id", t.alias("text"), null_key(F.col("lang")).alias("lang_key"), null_key(F.col("source")).alias("source_key"))
    m = metrics(keyed.withColumn("n_lines", n_lines)).drop("text")
    m = rates(cut(m))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    m = m.withColumn("base_failed", base)
    limits = cut(thresholds(cut(sketches(m.where(~F.col("base_failed"))))))
    held = join_small(m, limits, ["lang_key", "source_key"], salt=F.col("doc_id"))
    fine = ~F.col("base_failed")
    for k, side in METRICS.items():
        fine = fine & F.coalesce(F.col(k) <= F.col(f"max_{k}"), F.lit(True))
        if side == "both":
            fine = fine & F.coalesce(F.col(k) >= F.col(f"min_{k}"), F.lit(True))
    return held.withColumn("kept", fine)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _pooled(k: int) -> str:
    """SQL for a pooled quantile: of n sorted buckets the one that k hundredths reach, and the largest value in it."""
    nth = lambda t: f"{t}.l[({t}.n * {k} + 99) // 100]"
    top = lambda b: f"CASE WHEN {b} < 128 THEN {b} ELSE (({b} % 64 + 65)::BIGINT << ({b} // 64 - 1)::INT) - 1 END"
    return f"(q.n * ({top(nth('q'))}) + {POOL} * ({top(nth('ql'))}) + {POOL} * ({top(nth('qe'))})) // (q.n + {2 * POOL}) AS q{k}"


_METRICS = "['symbols_pm', 'dup_lines_pm', 'repeats_pm', 'word_len_c']"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('0' || lang, '1') AS lk, coalesce('0' || source, '1') AS sk FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i+4]) AS c FROM g),
r AS (SELECT doc_id, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS rep FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM h WHERE c > 1) GROUP BY doc_id),
m AS (SELECT doc_id, lk, sk, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        [1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)] AS v FROM m),
p AS (SELECT lk, sk, unnest({_METRICS}) AS metric, unnest(v) AS x FROM b WHERE NOT base_failed),
s AS (SELECT lk, sk, metric, e * 64 + (x >> e) AS bk FROM (SELECT *, greatest(length(bin(x)) - 7, 0)::INT AS e FROM p)),
q AS (SELECT lk, sk, metric, count(*) AS n, list_sort(list(bk)) AS l FROM s GROUP BY ALL),
ql AS (SELECT lk, metric, count(*) AS n, list_sort(list(bk)) AS l FROM s GROUP BY ALL),
qe AS (SELECT metric, count(*) AS n, list_sort(list(bk)) AS l FROM s GROUP BY ALL),
pooled AS (SELECT q.lk, q.sk, q.metric, {", ".join(_pooled(k) for k in QUANTILES)} FROM q JOIN ql USING (lk, metric) JOIN qe USING (metric)),
lim AS (SELECT lk, sk, metric, q90 + 3 * greatest(4 * (q90 - q10), q99 - q90) // 4 AS top, CASE metric WHEN 'word_len_c' THEN q10 - 3 * greatest(4 * (q90 - q10), q10 - q1) // 4 ELSE 0 END AS low FROM pooled),
over AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, lk, sk, unnest({_METRICS}) AS metric, unnest(v) AS x FROM b WHERE NOT base_failed) JOIN lim USING (lk, sk, metric) WHERE x > top OR x < low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND over.doc_id IS NULL AS kept
FROM b LEFT JOIN over USING (doc_id)
"""
