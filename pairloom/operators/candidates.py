"""Candidate building: every view and leg of the sparse blockers over all countries at once.

Country and state are join keys. Weights are fitted on the pool, apart for each country; a leg's rank is taken among
all s1 before those that nobody asked for are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import Scratch, checked, written
from . import blocking as B

REVERSE = {"name_addr": B.REVERSE_K}
ORPHAN = {"name": B.ORPHAN_K}


def view_rows(records: DataFrame, view: str) -> DataFrame:
    """id, country, key, text of a view."""
    return records.select("id", "country", "key", B.view_text(view).alias("text"))


def country_weights(pool: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """country, gram, idf of the grams within the frequency bounds of their country's pool (id, country, text)."""
    n = pool.groupBy("country").agg(F.count("*").alias("n"))
    grams = pool.select("country", F.explode(F.array_distinct(B.char_trigrams(F.col("text")))).alias("gram"))
    df = grams.groupBy("country", "gram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    kept = df.join(n, "country").where(F.col("df") <= max_df * F.col("n"))
    return kept.select("country", "gram", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """id, country, key, gram, w: sublinear tf times idf, of unit length for each id."""
    place = ["id", "country", "key"]
    tf = rows.select(*place, "text").repartition("id").select(*place, F.explode(B.char_trigrams(F.col("text"))).alias("gram")).groupBy(*place, "gram").agg(F.count("*").alias("tf"))
    raw = tf.join(idf, ["country", "gram"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    return raw.select(*place, "gram", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))).alias("w"))


def build_candidates(s1: DataFrame, pool: DataFrame, wanted: DataFrame | None = None, progress: Callable[[str], None] | None = None) -> DataFrame:
    """s1, cand and sim_/rk_ columns of each leg (f forward, r reverse, o orphan), null where the leg missed the pair.

    Records: id, country, state, city and the columns of the views; ids are unique within each table. Forward and reverse
    legs pair equal (country, state); pool rows whose state is unknown and cannot be inferred from their city meet all s1
    of their country in the orphan leg. wanted: s1, those to return candidates of; all if None. progress is told the name
    of each view before it is built. Null states count as empty; views of empty text give no pairs. What is written on the way is deleted.
    """
    with Scratch(s1.sparkSession) as tmp:
        return written(_candidates(s1, pool, wanted, progress or (lambda name: None), tmp), "candidates")


def _candidates(s1: DataFrame, pool: DataFrame, wanted: DataFrame | None, progress: Callable[[str], None], tmp: Scratch) -> DataFrame:
    s1 = s1.withColumn("key", B.grouped_state(F.col("state")))
    pool = B.partition_keys(s1, pool, within=("country",))
    within = lambda t: t.withColumn("part", F.to_json(F.struct("country", "key")))
    legs = {}
    for view, k in B.FORWARD_K.items():
        progress(view)
        rows, options = view_rows(pool, view), B.VIEWS[view]
        idf = checked(tmp.written(country_weights(rows, options.min_df, options.max_df), "idf"), B.BROADCAST_GRAMS)
        q, c = (tmp.written(vectors(t, idf), "vectors") for t in (view_rows(s1, view), rows))
        asked = q if wanted is None else q.join(wanted.select(F.col("s1").alias("id")).distinct(), "id", "left_semi")
        known = within(c.where("key <> '?'"))
        legs[f"f_{view}"] = B.top_k(B.similar(within(asked), known), "q", k)
        if view in REVERSE:
            legs[f"r_{view}"] = B.top_k(B.similar(within(q), known), "c", REVERSE[view])
        if view in ORPHAN:
            whole = lambda t: t.withColumn("part", F.col("country"))
            legs[f"o_{view}"] = B.top_k(B.similar(whole(q), whole(c.where("key = '?'"))), "c", ORPHAN[view])
    out = B.merge_legs(legs)
    return out if wanted is None else out.join(wanted.select("s1").distinct(), "s1", "left_semi")
