"""Learning a token dictionary (non-Latin to Latin) from true pairs of records.

A token is non-Latin if any of its letters is. Keys keep their case, as names and addresses are looked up before they are
lower-cased; targets are lower-cased. Null texts have no tokens; equally good targets go by the alphabet; repeated pairs
count as often as they stand; an empty table teaches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import is_latin


def _tokens(text: Column, pattern: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda t: t != "")


def aligned_tokens(pairs: DataFrame, least: int = 2) -> DataFrame:
    """From pairs (a, b) of equally many words: source (non-Latin, of b), target (Latin, of a at the same place), n; the most frequent target of each."""
    same = pairs.select(_tokens(F.lower("a"), r"\s+").alias("a"), _tokens(F.col("b"), r"\s+").alias("b")).where("size(a) = size(b)")
    each = same.select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.b").alias("source"), F.col("z.a").alias("target")).where(~is_latin(F.col("source")) & is_latin(F.col("target")))
    n = each.groupBy("source", "target").agg(F.count("*").alias("n"))
    w = W.partitionBy("source").orderBy(F.desc("n"), "target")
    return n.withColumn("__r", F.row_number().over(w)).where((F.col("__r") == 1) & (F.col("n") >= least)).drop("__r")


def cooccurring_tokens(pairs: DataFrame, least: int = 2) -> DataFrame:
    """From pairs (a, b): for each non-Latin token of b the token of a with the best n / sqrt(frequency in a), n >= least.

    Tokens of numbers alone are no targets; frequencies are those in pairs with a non-Latin token. source, target, n, score.
    """
    split = r"[\s,.;:()\-/]+"
    a = F.array_distinct(F.filter(_tokens(F.lower("a"), split), lambda t: ~t.rlike(r"^\p{Nd}+$")))
    b = F.array_distinct(F.filter(_tokens(F.col("b"), split), lambda t: ~is_latin(t)))
    rows = pairs.select(a.alias("a"), b.alias("b")).where(F.size("b") > 0)
    freq = rows.select(F.explode("a").alias("target")).groupBy("target").agg(F.count("*").alias("freq"))
    n = rows.select("a", F.explode("b").alias("source")).select("source", F.explode("a").alias("target")).groupBy("source", "target").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    scored = n.join(freq, "target").withColumn("score", F.round(F.col("n") / F.sqrt("freq"), 6))
    w = W.partitionBy("source").orderBy(F.desc("score"), "target")
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("source", "target", "n", "score")


def dictionary(names: DataFrame, addresses: DataFrame, least: int = 2) -> DataFrame:
    """source, target: evidence of names goes before that of addresses."""
    a = aligned_tokens(names, least).select("source", "target")
    return a.unionByName(cooccurring_tokens(addresses, least).select("source", "target").join(a.select("source"), "source", "left_anti"))


def as_map(words: DataFrame, most: int = 100_000) -> Column:
    """A learned dictionary (source, target) as a map literal for the normalisers. It passes through the driver: more than `most` words raise."""
    rows = words.select("source", "target").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} words")
    keys, values = [r.source for r in rows], [r.target for r in rows]
    return F.map_from_arrays(F.lit(keys) if keys else F.array().cast("array<string>"), F.lit(values) if values else F.array().cast("array<string>"))
