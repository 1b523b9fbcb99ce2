"""From scores to sets: ownership, thresholds, gates, and expected-F0.5 selection. Ties break by score desc, s1, cand.

Null scores own nothing that a score claims, reach no threshold and take no part in expectations. Repeated pairs count
as often as they stand, but own once. Empty tables choose nothing. Other columns pass through; names that begin with
two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def one_to_one(pairs: DataFrame, score: str = "p") -> DataFrame:
    """The best s1 of each candidate."""
    w = W.partitionBy("cand").orderBy(F.desc(score), "s1")
    return pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def select_threshold(pairs: DataFrame, t: float, score: str = "p") -> DataFrame:
    return pairs.where(F.col(score) >= t)


def gated(pairs: DataFrame, gate: DataFrame, g: float) -> DataFrame:
    """Pairs of the s1 whose gate (s1, gate) reaches g."""
    return pairs.join(gate.where(F.col("gate") >= g).select("s1"), "s1", "left_semi")


def s1_table(pairs: DataFrame, tops: tuple[str, ...] = ()) -> DataFrame:
    """One row for each s1: best three scores, sum, counts, how many candidates a rival has a better claim to, and the best candidate's columns tops as g_top_<name>."""
    rival = W.partitionBy("cand").orderBy(F.desc("p"), "s1")
    own = W.partitionBy("s1").orderBy(F.desc("p"), "cand")
    df = pairs.withColumn("__o", F.row_number().over(rival)).withColumn("__r", F.row_number().over(own))
    at = lambda k: F.max(F.when(F.col("__r") == k, F.col("p")))
    return df.groupBy("s1").agg(
        at(1).alias("g_p1"), at(2).alias("g_p2"), at(3).alias("g_p3"), F.round(F.sum("p"), 6).alias("g_sum"), F.count_if(F.col("p") >= 0.5).alias("g_n05"),
        F.count_if(F.col("p") >= 0.2).alias("g_n02"), F.count("*").alias("g_n"), F.count_if(F.col("__o") > 1).alias("g_lost"), *[F.max(F.when(F.col("__r") == 1, F.col(c))).alias(f"g_top_{c}") for c in tops],
    )


def expected_f_approx(pairs: DataFrame, least: float = 0.05) -> DataFrame:
    """Pairs that maximise the approximate expected F0.5, if that beats the chance of no match at all.

    Value of the first k by score: 1.25 * sum_k / (0.25 * sum_all + k); the smallest best k wins.
    """
    own = W.partitionBy("s1").orderBy(F.desc("p"), "cand").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("s1")
    df = pairs.where(F.col("p") >= least).withColumns({"k": F.count("*").over(own), "run": F.sum("p").over(own), "total": F.sum("p").over(whole)})
    # a certain match makes no match impossible; ln(0) would be null
    none = F.when(F.max("p").over(whole) >= 1, 0.0).otherwise(F.exp(F.sum(F.ln(1 - F.least(F.col("p"), F.lit(1 - 1e-12)))).over(whole)))
    df = df.withColumns({"value": F.round(1.25 * F.col("run") / (0.25 * F.col("total") + F.col("k")), 9), "none": none})
    best = df.withColumn("top", F.max("value").over(whole)).withColumn("best_k", F.min(F.when(F.col("value") == F.col("top"), F.col("k"))).over(whole))
    return best.where("k <= best_k and top > none").select("s1", "cand", "p", "best_k")


def hits(ps: Column) -> Column:
    """The distribution of the number of matches among independent chances (Poisson-binomial), by the usual recurrence: n + 1 values."""

    def add(dist, p):
        longer = F.concat(dist, F.array(F.lit(0.0)))
        shifted = F.concat(F.array(F.lit(0.0)), dist)
        return F.zip_with(longer, shifted, lambda u, v: u * (1 - p) + v * p)

    return F.aggregate(ps, F.array(F.lit(1.0)), add)


def expected_f(inside: Column, outside: Column) -> Column:
    """The exact expected F0.5 of predicting `inside` of the chances inside and outside; without any, the chance that nothing matches."""
    k, head, tail = F.size(inside), hits(inside), hits(outside)
    cells = F.transform(head, lambda pa, i: F.aggregate(F.transform(tail, lambda pb, j: pa * pb * 1.25 * i / (0.25 * (i + j) + k)), F.lit(0.0), lambda acc, v: acc + v))
    return F.when(k == 0, F.element_at(tail, 1)).otherwise(F.aggregate(cells, F.lit(0.0), lambda acc, v: acc + v))


def expected_f_of_k(ps: Column) -> Column:
    """For scores in descending order the exact expected F0.5 of predicting the first k, k = 0..n, matches independent."""
    n = F.size(ps)
    return F.transform(F.sequence(F.lit(0), n), lambda k: expected_f(F.slice(ps, F.lit(1), k), F.slice(ps, k + 1, n)))


def expected_f_exact(pairs: DataFrame, gate: DataFrame | None = None, least: float = 0.01, most: int = 20) -> DataFrame:
    """Pairs of the first k by score for the k of the best exact expected F0.5 (first maximum); at most `most` candidates count.

    With a gate (s1, gate = chance of any match), k = 0 is worth 1 - gate, or 1 for an s1 the gate lacks.
    """
    own = W.partitionBy("s1").orderBy(F.desc("p"), "cand")
    df = pairs.where(F.col("p") >= least).withColumn("r", F.row_number().over(own)).where(F.col("r") <= most)
    lists = df.groupBy("s1").agg(F.sort_array(F.collect_list(F.struct("r", "cand", "p"))).alias("l"))
    values = expected_f_of_k(F.col("l.p"))
    if gate is not None:
        lists = lists.join(gate.select("s1", "gate"), "s1", "left")
        values = F.concat(F.array(1 - F.coalesce("gate", F.lit(0.0))), F.slice(values, 2, 10_000))
    lists = lists.withColumn("v", F.transform(values, lambda x: F.round(x, 9)))
    k = (F.array_position("v", F.array_max("v")) - 1).cast("int")
    return lists.withColumn("best_k", k).withColumn("expected", F.array_max("v")).select("s1", "best_k", "expected", F.explode(F.slice("l", 1, F.greatest(F.col("best_k"), F.lit(0)))).alias("x")).select("s1", "x.cand", "x.p", "best_k", "expected")


def normalised_by_owner(pairs: DataFrame) -> DataFrame:
    """q: p over the candidate's total, where that exceeds one."""
    return pairs.withColumn("q", F.col("p") / F.greatest(F.lit(1.0), F.sum("p").over(W.partitionBy("cand"))))


def match_lists(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """s1, matched: sorted distinct candidates, comma-joined; every id once, '' without candidates."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set(F.col("cand").cast("string"))), ",").alias("matched"))
    return ids.select("s1").distinct().join(lists, "s1", "left").select("s1", F.coalesce("matched", F.lit("")).alias("matched"))
