"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_small, null_key, table, word_count

#: About how many documents of one source are looked at one by one.
LEAF = 4096


@dataclass(frozen=True)
class Mix:
    """How often each document is taken; see :func:`plan_mix`."""

    sources: DataFrame
    chosen: DataFrame
    seed: int

    def repeats(self, docs: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
        """``docs`` with ``__source_size, __target, __repeats``; neither texts nor rows are shuffled."""
        order = draw(docs[id_col], self.seed)
        keyed = docs.withColumns({"__s": null_key(docs[source_col]), "__k": order, "__id": null_key(docs[id_col])})
        held = join_small(keyed, self.sources.select("__s", "__source_size", "__target", "__whole", "__depth", "__edge"), ["__s"], salt=F.col("__k"))
        picked = join_small(held, self.chosen, ["__s", "__id"], salt=F.col("__k"))
        inside = F.substring("__k", 1, 8).substr(F.lit(1), F.col("__depth"))
        more = F.coalesce(F.col("__edge").isNotNull() & ((inside < F.col("__edge")) | F.col("__picked").isNotNull()), F.lit(False))
        return picked.withColumn("__repeats", F.col("__whole") + more.cast("long")).drop("__s", "__k", "__id", "__whole", "__depth", "__edge", "__picked")


def draw(doc_id: Column, seed: int) -> Column:
    """The seeded order in which a source's documents are drawn."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan_mix(sizes: DataFrame, weights: Column, share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> Mix:
    """Decide how often each document of ``sizes (doc_id, source, size)`` is taken.

    ``weights`` is a column over ``rank``, the 0-based place of a source by code point, null last. The sources share
    ``share`` times all sizes by weight, each at most ``epochs`` times its size; what is over goes to the others by
    weight until all are feasible. A source's documents all get the whole repetitions that fit into its target; for
    the rest, documents are taken once more in a seeded order until the target is met as nearly as whole documents
    allow. The order is cut into leaves of about :data:`LEAF` documents: leaves wholly below the target are taken, only
    the one at the edge is walked through. Rows with one source and id are taken together.
    """
    w_all = Window.orderBy("__s")
    per = sizes.groupBy(null_key(F.col("source")).alias("__s")).agg(F.sum("size").alias("__source_size"), F.count(F.lit(1)).alias("__docs"))
    ranked = per.withColumn("rank", F.row_number().over(w_all) - 1).withColumn("__w", weights.cast("double"))
    ranked = ranked.withColumn("__cap", F.col("__source_size") * F.lit(float(epochs)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "__s").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns({
        "__total": F.sum("__source_size").over(everything) * F.lit(float(share)),
        "__place": F.row_number().over(Window.orderBy(F.col("__cap") / F.col("__w"), "__s")),
        "__full": F.coalesce(F.sum("__cap").over(before), F.lit(0.0)),
        "__left": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
    })
    fits = (F.col("__total") - F.col("__full")) * F.col("__w") / F.col("__left") <= F.col("__cap")
    filled = filled.withColumn("__first", F.min(F.struct(F.when(fits, F.col("__place")).otherwise(F.lit(2**31 - 1)).alias("p"), (F.col("__total") - F.col("__full")).alias("rest"), F.col("__left").alias("w"))).over(everything))
    target = F.when(F.col("__place") < F.col("__first.p"), F.col("__cap")).otherwise(F.col("__first.rest") * F.col("__w") / F.col("__first.w"))
    whole = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(0)).cast("long")
    depth = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("__docs") / F.lit(float(LEAF))) - F.lit(1e-9))).cast("int")
    sources = filled.withColumn("__target", target).withColumn("__whole", whole)
    sources = cut(sources.select("__s", "__source_size", "__target", "__whole", F.floor(F.col("__target") - F.col("__whole") * F.col("__source_size") + 0.5).cast("long").alias("__need"), F.least(depth, F.lit(8)).alias("__depth")))

    keyed = sizes.select(null_key(F.col("source")).alias("__s"), null_key(F.col("doc_id")).alias("__id"), draw(F.col("doc_id"), seed).alias("__k"), "size")
    held = join_small(keyed, sources.select("__s", "__need", "__depth"), ["__s"], "inner", F.col("__k")).where("__need > 0")
    held = held.withColumn("__leaf", F.substring("__k", 1, 8).substr(F.lit(1), F.col("__depth")))
    leaves = held.groupBy("__s", "__leaf", "__need").agg(F.sum("size").alias("__in"))
    leaves = leaves.withColumn("__before", F.coalesce(F.sum("__in").over(Window.partitionBy("__s").orderBy("__leaf").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edges = leaves.where("__before < __need AND __before + __in >= __need").groupBy("__s").agg(F.min(F.struct("__leaf", (F.col("__need") - F.col("__before")).alias("gap"))).alias("e"))
    edges = cut(edges.select("__s", F.col("e.__leaf").alias("__edge"), F.col("e.gap").alias("__gap")))

    at = join_small(held, edges, ["__s"], "inner", F.col("__k")).where("__leaf = __edge")
    units = at.groupBy("__s", "__k", "__id", "__gap").agg(F.sum("size").alias("size")).withColumn("__took", F.lit(False))
    whole_source = Window.partitionBy("__s")
    for _ in range(3):  # what did not fit leaves a gap, into which smaller documents may fit
        may = ~F.col("__took") & (F.col("size") <= F.col("__gap"))
        run = F.sum(F.when(may, F.col("size")).otherwise(0)).over(Window.partitionBy("__s").orderBy("__k", "__id").rowsBetween(Window.unboundedPreceding, 0))
        units = units.withColumn("__now", may & (run <= F.col("__gap")))
        units = units.withColumn("__gap", F.col("__gap") - F.sum(F.when(F.col("__now"), F.col("size")).otherwise(0)).over(whole_source)).withColumn("__took", F.col("__took") | F.col("__now"))
    chosen = cut(units.where("__took").select("__s", "__id", F.lit(True).alias("__picked")))
    full = join_small(sources.drop("__need"), edges.select("__s", "__edge"), ["__s"])
    return Mix(cut(full), chosen, seed)


def sizes_of(docs: DataFrame) -> DataFrame:
    return cut(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(docs["text"]).alias("size")))


def cycled(weights: tuple[float, ...]) -> Column:
    """Weights that repeat over the sources' ranks."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (0, 1, 2 ... times), columns unchanged.

    A null text has size 0, a null source is a source of its own that comes last, null ids are drawn together. Documents
    without words are in a source's whole repetitions. Empty input gives empty output. Extra columns pass through.
    """
    mix = plan_mix(sizes_of(docs), cycled(weights), share, epochs, seed)
    held = mix.repeats(docs.select("doc_id", "source", F.struct("*").alias("__row"))).where("__repeats > 0")
    return held.select("__row", F.explode(F.sequence(F.lit(1), F.col("__repeats")))).select("__row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sizes_of(table(spark, sf_dir, "documents"))
    held = plan_mix(sizes, cycled((3, 1, 2))).repeats(sizes)
    return held.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__repeats")).alias("taken"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s, md5('17:' || doc_id) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT s, sum(size)::BIGINT AS ss, count(*) AS n FROM docs GROUP BY s),
ranked AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT]::DOUBLE AS w, ss * 2.0::DOUBLE AS cap FROM per),
placed AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, s) AS place, (sum(ss) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
         (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS wleft FROM ranked),
first AS (SELECT place AS p, total - filled AS rest, wleft AS wl FROM placed WHERE (total - filled) * w / wleft <= cap ORDER BY place LIMIT 1),
aimed AS (SELECT s, ss, n, CASE WHEN p IS NULL OR place < p THEN cap ELSE rest * w / wl END AS target FROM placed LEFT JOIN first ON true),
src AS (
  SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END::BIGINT AS whole,
         CASE WHEN n <= 4096 THEN 0 WHEN n <= 65536 THEN 1 WHEN n <= 1048576 THEN 2 WHEN n <= 16777216 THEN 3 ELSE 4 END AS depth FROM aimed),
need AS (SELECT *, floor(target - whole * ss + 0.5)::BIGINT AS need FROM src),
held AS (SELECT d.*, need.need, substr(k, 1, depth) AS leaf FROM docs d JOIN need USING (s) WHERE need > 0),
leaves AS (SELECT s, leaf, need, sum(size)::BIGINT AS inn FROM held GROUP BY ALL),
run AS (SELECT *, coalesce(sum(inn) OVER (PARTITION BY s ORDER BY leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM leaves),
edge AS (SELECT s, min(leaf) AS edge, arg_min(need - bef, leaf) AS gap FROM run WHERE bef < need AND bef + inn >= need GROUP BY s),
u0 AS (SELECT h.s, h.k, h.doc_id, h.size, e.gap, false AS took FROM held h JOIN edge e ON h.s = e.s AND h.leaf = e.edge),
n1 AS (SELECT *, (NOT took AND size <= gap) AND sum(CASE WHEN NOT took AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY s ORDER BY k, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) <= gap AS now FROM u0),
u1 AS (SELECT s, k, doc_id, size, gap - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY s) AS gap, took OR now AS took FROM n1),
n2 AS (SELECT *, (NOT took AND size <= gap) AND sum(CASE WHEN NOT took AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY s ORDER BY k, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) <= gap AS now FROM u1),
u2 AS (SELECT s, k, doc_id, size, gap - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY s) AS gap, took OR now AS took FROM n2),
n3 AS (SELECT *, (NOT took AND size <= gap) AND sum(CASE WHEN NOT took AND size <= gap THEN size ELSE 0 END) OVER (PARTITION BY s ORDER BY k, doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) <= gap AS now FROM u2),
chosen AS (SELECT s, doc_id FROM n3 WHERE took OR now)
SELECT d.doc_id, d.size, n.ss AS source_size, n.target,
       d.size * (n.whole + CASE WHEN substr(d.k, 1, n.depth) < e.edge OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS taken
FROM docs d JOIN need n USING (s) LEFT JOIN edge e USING (s) LEFT JOIN chosen c ON c.s = d.s AND c.doc_id = d.doc_id
"""
