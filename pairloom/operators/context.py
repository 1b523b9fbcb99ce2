"""Window features over the candidate graph. Pairs are (s1, cand, score); ranks are ordinal and break ties by s1, cand.

Null scores rank last, count as absent in sums and maxima, and have null gaps and margins. Repeated pairs are separate rows (build_context
refuses them). Empty tables give empty tables with all columns. Other columns of pairs pass through; names that begin with
two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _ranked(key: str, score: str) -> W:
    return W.partitionBy(key).orderBy(F.col(score).desc_nulls_last(), "s1", "cand")


def context_features(pairs: DataFrame, p: str = "p") -> DataFrame:
    """pairs with the c_ columns: ranks, gaps, counts and sums within s1, and the competition for cand."""
    own, rival = W.partitionBy("s1"), W.partitionBy("cand")
    x = F.col(p)
    df = pairs.withColumns({
        "c_rank_s1": F.row_number().over(_ranked("s1", p)), "c_pmax_s1": F.max(x).over(own), "c_psum_s1": F.sum(x).over(own),
        "c_n05_s1": F.count_if(x >= 0.5).over(own), "c_n02_s1": F.count_if(x >= 0.2).over(own), "c_ncand_s1": F.count("*").over(own),
        "c_rank_cand": F.row_number().over(_ranked("cand", p)), "c_nclaim": F.count("*").over(rival), "c_pmax_cand": F.max(x).over(rival), "c_pother_cand": F.sum(x).over(rival) - x,
    })
    second = F.coalesce(F.max(F.when(F.col("c_rank_cand") == 2, x)).over(rival), F.lit(0.0))
    return df.withColumn("c_gap_s1", F.col("c_pmax_s1") - x).withColumn("c_margin_cand", F.when(F.col("c_rank_cand") == 1, x - second).otherwise(x - F.col("c_pmax_cand")))


def top_agreement(pairs: DataFrame, attrs: DataFrame, similarity) -> DataFrame:
    """pairs with each candidate's agreement with the best candidate of its s1: c_top_name, c_top_addr (null for the best
    itself), c_top_house (-2 itself, -1 a house is missing, else 0 or 1). attrs: cand, name, addr, house."""
    fields = ("name", "addr", "house")
    best = pairs.withColumn("__r", F.row_number().over(_ranked("s1", "p"))).where("__r = 1").select("s1", F.col("cand").alias("__top"))
    best = best.join(attrs.select(F.col("cand").alias("__top"), *[F.col(c).alias(f"__t_{c}") for c in fields]), "__top", "left")
    own = attrs.select("cand", *[F.col(c).alias(f"__o_{c}") for c in fields])
    df = pairs.join(best, "s1", "left").join(own, "cand", "left")
    self, house = F.col("cand") == F.col("__top"), F.col("__o_house") == F.col("__t_house")
    missing = (F.coalesce("__o_house", F.lit("")) == "") | (F.coalesce("__t_house", F.lit("")) == "")
    return df.withColumns({
        "c_top_name": F.when(~self, similarity(F.col("__o_name"), F.col("__t_name"))), "c_top_addr": F.when(~self, similarity(F.col("__o_addr"), F.col("__t_addr"))),
        "c_top_house": F.when(self, -2).when(missing, -1).otherwise(house.cast("int")),
    }).drop("__top", *[f"__{k}_{c}" for k in "to" for c in fields])


#: Model scores that build_context knows: column of the channel table, and the prefix of its context features.
CHANNELS: dict[str, str] = {"xenc": "x", "llm": "l"}


def register_score_channel(name: str, prefix: str) -> None:
    """Let build_context derive rank, gap and margin of a model score, under the prefix."""
    CHANNELS[name] = prefix


def build_context(pairs: DataFrame, attrs: DataFrame, similarity, channels: DataFrame | None = None, least: float = 0.01) -> DataFrame:
    """All context of the pairs with p of at least `least`: c_ and t_ columns, and the model scores of channels
    (s1, cand, one column for each score), null where a channel lacks the pair, with their own rank, gap and margin if
    they are among CHANNELS. Repeated pairs raise an error."""
    key = W.partitionBy("s1", "cand")
    once = F.when(F.count("*").over(key) > 1, F.raise_error(F.lit("repeated pair"))).otherwise(F.lit(True))
    kept = pairs.where(F.col("p") >= least).withColumn("__once", once).where("__once").drop("__once")
    out = group_support(top_agreement(context_features(kept), attrs, similarity), attrs, similarity)
    if channels is None:
        return out
    out = out.join(channels, ["s1", "cand"], "left")
    for name in channels.columns:
        if name in CHANNELS:
            out = score_context(out, name, CHANNELS[name])
    return out


def score_context(pairs: DataFrame, score: str, prefix: str) -> DataFrame:
    """Rank, gap and margin of any score; null scores keep null features, and a candidate without a scored rival a null margin."""
    x, have = F.col(score), F.col(score).isNotNull()
    own, rival = W.partitionBy("s1"), W.partitionBy("cand")
    rank_c = F.row_number().over(_ranked("cand", score))
    df = pairs.withColumn("__rc", rank_c)
    second = F.max(F.when(F.col("__rc") == 2, x)).over(rival)
    return df.withColumns({
        f"{prefix}_rank_s1": F.when(have, F.row_number().over(_ranked("s1", score))), f"{prefix}_gap_s1": F.max(x).over(own) - x,
        f"{prefix}_rank_cand": F.when(have, F.col("__rc")), f"{prefix}_margin_cand": F.when(have, F.when(F.col("__rc") == 1, x - second).otherwise(x - F.max(x).over(rival))),
    }).drop("__rc")


def group_support(pairs: DataFrame, attrs: DataFrame, similarity, top: int = 4, least: float = 0.8) -> DataFrame:
    """Each candidate against the other best candidates of its s1: t_ columns; null where there is no other.

    attrs: cand, name, addr, house. similarity: (Column, Column) -> Column in [0, 1], null counts as 0.
    """
    ranked = pairs.withColumn("rk", F.row_number().over(_ranked("s1", "p")))
    best = ranked.where(F.col("rk") <= top).select("s1", F.col("cand").alias("o"), F.col("p").alias("po")).join(attrs.select(F.col("cand").alias("o"), *[F.col(c).alias(f"o_{c}") for c in ("name", "addr", "house")]), "o")
    mine = pairs.select("s1", "cand").join(attrs, "cand")
    both = mine.join(best, "s1").where("cand <> o")
    ns, as_ = (F.coalesce(similarity(F.col(c), F.col(f"o_{c}")), F.lit(0.0)) for c in ("name", "addr"))
    both = both.withColumns({"ns": ns, "as": as_})
    agree = F.when((F.col("house") == "") | (F.col("o_house") == ""), 0.5).otherwise((F.col("house") == F.col("o_house")).cast("double"))
    weight = F.greatest(F.sum("po"), F.lit(1e-6))
    return pairs.join(both.groupBy("s1", "cand").agg(
        F.max("ns").alias("t_name_max"), F.max("as").alias("t_addr_max"), (F.sum(F.col("ns") * F.col("po")) / weight).alias("t_name_mean"), (F.sum(F.col("as") * F.col("po")) / weight).alias("t_addr_mean"),
        F.sum(F.when((F.col("ns") >= least) & (F.col("as") >= least), F.col("po")).otherwise(0.0)).alias("t_support"), F.max(agree).alias("t_house_agree"), F.count("*").alias("t_n_others"),
    ), ["s1", "cand"], "left")


def peer_support(pairs: DataFrame, attrs: DataFrame, similarity, names: int = 4, ids: int = 2) -> DataFrame:
    """Corroboration by differently named peers: max, p-weighted support, number of sure sources.

    Of each s1, up to `names` distinct names by best score, up to `ids` candidates of each; a peer name
    contributes its first candidate that is not the row's own. attrs: cand, name, src.
    """
    attrs = attrs.select("cand", "name", "src")
    rows = pairs.select("s1", "cand", "p").join(attrs, "cand").where("name <> ''")
    in_name = W.partitionBy("s1", "name").orderBy(F.desc("p"), "cand")
    rows = rows.withColumn("k", F.row_number().over(in_name)).where(F.col("k") <= ids)
    firsts = rows.where("k = 1").withColumn("rank", F.row_number().over(W.partitionBy("s1").orderBy(F.desc("p"), "cand"))).where(F.col("rank") <= names).select("s1", F.col("name").alias("peer_name"))
    peers = rows.withColumnRenamed("name", "peer_name").join(firsts, ["s1", "peer_name"], "left_semi").select("s1", F.col("cand").alias("o"), F.col("p").alias("po"), "peer_name", F.col("src").alias("src_o"), "k")
    both = pairs.select("s1", "cand").join(attrs.select("cand", "name"), "cand").join(peers, "s1").where("cand <> o")
    one = both.withColumn("first", F.row_number().over(W.partitionBy("s1", "cand", "peer_name").orderBy("k"))).where("first = 1")
    one = one.withColumn("sim", F.coalesce(similarity(F.col("name"), F.col("peer_name")), F.lit(0.0)))
    sure = F.when((F.col("po") >= 0.9) & (F.col("sim") >= 0.8), F.col("src_o"))
    got = one.groupBy("s1", "cand").agg(F.max("sim").alias("peer_max"), F.sum(F.col("sim") * F.col("po")).alias("peer_support"), F.count_distinct(sure).alias("peer_sources"))
    return pairs.join(got, ["s1", "cand"], "left")


def name_margin(pairs: DataFrame, score: str = "j") -> DataFrame:
    """Margin to the best other claimant of cand (0 on ties, 1 if alone) and the number of competitors."""
    rival, x = W.partitionBy("cand"), F.col(score)
    df = pairs.withColumn("__r", F.row_number().over(_ranked("cand", score))).withColumn("n_rivals", F.count("*").over(rival) - 1)
    second = F.max(F.when(F.col("__r") == 2, x)).over(rival)
    return df.withColumn("name_margin", F.when(F.col("n_rivals") == 0, 1.0).when(F.col("__r") == 1, x - second).otherwise(x - F.max(x).over(rival))).drop("__r")


def repair_scope(pairs: DataFrame, blank: Column) -> DataFrame:
    """repair: doubtful score, blank address, or a near tie at the top."""
    own, x = W.partitionBy("s1"), F.col("p")
    df = pairs.withColumn("__r", F.row_number().over(_ranked("s1", "p")))
    top, second = F.max(x).over(own), F.max(F.when(F.col("__r") == 2, x)).over(own)
    near = (top - second <= 0.15) & (top - x <= 0.15)
    return df.withColumn("repair", x.between(0.05, 0.95) | blank | F.coalesce(near, F.lit(False))).drop("__r")


def owner_dropout(pairs: DataFrame, percent: int, seed: str = "drop") -> DataFrame:
    """pairs without a hash-chosen share of s1, so that competition features can be recomputed."""
    keep = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("s1").cast("string"))), 1, 8), 16, 10).cast("long") % 100 >= percent
    return pairs.where(keep)
