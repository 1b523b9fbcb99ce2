"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Method. Every document draws an exponential key, -ln(u) / weight, where u follows from its doc_id by a
digest and weight is its quality weight: sorted by key, a prefix is a weighted sample without
replacement. A source's target of words is met by complete epochs first; the rest of the target
(less than an epoch) takes documents in key order until their prefix sum comes nearest to it.

No source is sorted as a whole. Keys fall into BUCKETS ranges; sums of each source's ranges locate the
one where the target is met, and only that range's rows are sorted. What results is a plan of
one row per source (target, epochs, cut); a document's copies follow from its own row and
the plan, so a third of all rows in one source is no hot spot. The plan is made on the driver: it has one row for
each source, as the weights that a mix is given have.

Defined results. Null text has size 0; a null source is a source, last in order. Rows of equal doc_id and key in a
source are taken together. Null doc_ids draw the key of the empty string. Sources without words
have target 0. An empty table gives no rows. Extra columns pass through mix() untouched; names that begin with __mix_ are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

BUCKETS = 4_096
#: Plans of up to so many sources are broadcast.
BROADCAST_SOURCES = 10_000
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2
USUAL_WORD = 6.0


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def shape_weight(text: Column, size: Column) -> Column:
    """A quality weight in (0, 1] for tables that have none: 1 where the mean word length is usual, less the further off it is."""
    mean = F.length(F.coalesce(text, F.lit(""))) / F.greatest(size, F.lit(1))
    return 1 / (1 + F.abs(mean - USUAL_WORD) / USUAL_WORD)


def key_of(doc_id: Column, weight: Column, seed: str) -> Column:
    """The exponential key; u has 52 bits of a digest and is never 0 or 1."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 4503599627370496.0
    return -F.ln(u) / weight


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Each source's words: share times all, by weight; none over limit times its size, the excess reshared by weight."""
    out: list[float | None] = [None] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: limit * sizes[k] / weights[k])
    left, weight = share * sum(sizes), float(sum(weights))
    for k in order:
        if left * weights[k] / weight < limit * sizes[k]:
            break
        out[k] = float(limit * sizes[k])
        left, weight = left - out[k], weight - weights[k]
    return [left * weights[k] / weight if out[k] is None else out[k] for k in range(len(sizes))]


def keyed(docs: DataFrame, weight: Column | None = None, seed: str = "mix") -> DataFrame:
    """docs with __mix_size, __mix_key and __mix_bucket (reserved names); weight may use the first."""
    rows = docs.withColumn("__mix_size", size_of(F.col("text")))
    rows = rows.withColumn("__mix_key", key_of(F.col("doc_id"), shape_weight(F.col("text"), F.col("__mix_size")) if weight is None else weight, seed))
    return rows.withColumn("__mix_bucket", F.least(F.floor((1 - F.exp(-F.col("__mix_key"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))


def plan(rows: DataFrame, tmp: common.Scratch, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """Of keyed rows (doc_id, source, mix_*) the plan: source, source_size, target, epochs, cut_bucket, cut_key, cut_doc.

    Sources are in code point order, null last; weights repeat over them.
    """
    spark = rows.sparkSession
    sums = tmp.written(rows.groupBy("source", "__mix_bucket").agg(F.sum("__mix_size").alias("n")), "ranges")
    sizes = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    total = [r.n for r in sizes]
    goal = targets(total, [weights[k % len(weights)] for k in range(len(total))]) if total else []
    epochs = [int(g // n) if n else 0 for g, n in zip(goal, total)]
    made = [(r.source, n, float(g), e, float(g - e * n)) for r, n, g, e in zip(sizes, total, goal, epochs)]
    goals = spark.createDataFrame(made, "source string, source_size long, target double, epochs int, rest double")
    goals = F.broadcast(goals) if len(made) <= BROADCAST_SOURCES else goals
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = W.partitionBy("source").orderBy("__mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    met = ranges.join(goals, same(ranges, goals)).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))).select(goals["source"].alias("s"), F.col("__mix_bucket").alias("b"), "before", "rest")
    met = tmp.written(met, "met")
    edge = rows.select("source", "__mix_bucket", "__mix_key", "doc_id", "__mix_size").join(met, F.col("source").eqNullSafe(F.col("s")) & (F.col("__mix_bucket") == F.col("b")))
    edge = edge.groupBy("source", "b", "before", "rest", "__mix_key", "doc_id").agg(F.sum("__mix_size").alias("n"))
    own = W.partitionBy("source").orderBy("__mix_key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.withColumn("at", F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0)))
    out = edge.where(F.col("at") + F.col("n") / 2 > F.col("rest")).groupBy("source").agg(F.min(F.struct("__mix_key", "doc_id")).alias("cut"))
    cuts = {r.s: r.b for r in met.collect()}
    first = {r.source: r.cut for r in out.collect()}
    full = [(s, n, g, e, cuts.get(s, -1), first[s]["__mix_key"] if s in first else None, first[s]["doc_id"] if s in first else None) for s, n, g, e, _ in made]
    return spark.createDataFrame(full, "source string, source_size long, target double, epochs int, cut_bucket int, cut_key double, cut_doc long")


def apply_plan(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Keyed rows with __mix_source_size, __mix_target and __mix_copies, how often the mix takes the row."""
    small = made.count() <= BROADCAST_SOURCES
    made = made.select(*[F.col(c).alias(f"__mix_{c}") for c in made.columns])
    got = rows.join(F.broadcast(made) if small else made, F.col("source").eqNullSafe(F.col("__mix_source")))
    key, cut, doc = F.col("__mix_key"), F.col("__mix_cut_key"), F.col("__mix_cut_doc")
    before = F.coalesce(F.col("doc_id") < doc, F.col("doc_id").isNull() & doc.isNotNull())
    under = cut.isNull() | (key < cut) | ((key == cut) & before)
    taken = (F.col("__mix_bucket") < F.col("__mix_cut_bucket")) | ((F.col("__mix_bucket") == F.col("__mix_cut_bucket")) & under)
    return got.withColumn("__mix_copies", F.col("__mix_epochs") + taken.cast("int")).drop("__mix_source", "__mix_epochs", "__mix_cut_bucket", "__mix_cut_key", "__mix_cut_doc")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, weight: Column | None = None) -> DataFrame:
    """docs (doc_id, text, source, ...) as the mix takes them: each row as often as it is taken, same columns."""
    names = docs.columns
    with common.Scratch(docs.sparkSession) as tmp:
        keys = tmp.written(keyed(docs, weight).select("doc_id", "source", "__mix_size", "__mix_key", "__mix_bucket"), "keys")
        made = plan(keys, tmp, weights)
    got = apply_plan(keyed(docs, weight), made)
    return got.where("__mix_copies > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_copy")).drop("__mix_copy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: how the mix takes each of all documents."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    keys = common.written(keyed(docs).select("doc_id", "source", "__mix_size", "__mix_key", "__mix_bucket"), "keys")
    with common.Scratch(spark) as tmp:
        got = apply_plan(keys, plan(keys, tmp))
    return got.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS chars,
         (CAST(('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / (1.0::DOUBLE / (1 + abs(chars::DOUBLE / greatest(size, 1) - 6.0::DOUBLE) / 6.0::DOUBLE)) AS key FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left
  FROM s WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT min_by(rest, cap / w) AS rest, min_by(w_left, cap / w) AS w_left, min(cap / w) AS edge FROM c WHERE rest * w / w_left < cap),
t AS (
  SELECT source, source_size, CASE WHEN edge IS NULL OR cap / w < edge THEN cap ELSE f.rest * w / f.w_left END AS target FROM c, f),
r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN prev + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
