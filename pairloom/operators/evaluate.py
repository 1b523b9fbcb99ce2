"""Evaluation, audit and statistics. Predictions and truth are pair tables (s1, cand); ids lists every s1 that counts.

Repeated pairs and ids count once. Pairs of an s1 that ids lacks do not count; pairs with a null key match nothing. Without ids, means are
null and counts 0. Names that begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import written


def f05(tp: Column, n_true: Column, n_pred: Column) -> Column:
    """Entity F0.5 in closed form: 1 if there is nothing to find and nothing is predicted."""
    return F.when((n_true == 0) & (n_pred == 0), 1.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def entity_counts(ids: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """s1, tp, n_true, n_pred, f."""
    both = pred.select("s1", "cand", F.lit(1).alias("ip")).distinct().join(truth.select("s1", "cand", F.lit(1).alias("it")).distinct(), ["s1", "cand"], "full")
    n = both.groupBy("s1").agg(F.count_if(F.col("ip").isNotNull() & F.col("it").isNotNull()).alias("tp"), F.count("it").alias("n_true"), F.count("ip").alias("n_pred"))
    df = ids.select("s1").distinct().join(n, "s1", "left").fillna(0, ["tp", "n_true", "n_pred"])
    return df.withColumn("f", f05(F.col("tp"), F.col("n_true"), F.col("n_pred")))


def macro_f05(ids: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n, macro_f05, the mean over all ids."""
    return entity_counts(ids, pred, truth).agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("macro_f05"))


def by_group(ids: DataFrame, pred: DataFrame, truth: DataFrame, group: str) -> DataFrame:
    """For each group of ids (s1, group): n, f05, and its share of the whole loss."""
    df = entity_counts(ids, pred, truth).join(ids.select("s1", group).distinct(), "s1")
    one = df.groupBy(group).agg(F.count("*").alias("n"), F.avg("f").alias("f"), F.sum(1 - F.col("f")).alias("loss"))
    total = one.agg(F.sum("loss").alias("all_loss"))
    return one.join(F.broadcast(total)).select(group, "n", F.round("f", 6).alias("f05"), F.round(F.col("loss") / F.nullif(F.col("all_loss"), F.lit(0.0)), 6).alias("loss_share"))


def decomposition(ids: DataFrame, pred: DataFrame, truth: DataFrame, cands: DataFrame) -> DataFrame:
    """One row: macro F as is, without false positives, without false negatives, without decision misses, and with a perfect matcher."""
    flag = lambda d, c: d.select("s1", "cand", F.lit(1).alias(c)).distinct()
    df = flag(pred, "ip").join(flag(truth, "it"), ["s1", "cand"], "full").join(flag(cands, "ic"), ["s1", "cand"], "left")
    p, t, c = (F.col(x).isNotNull() for x in ("ip", "it", "ic"))
    n = df.groupBy("s1").agg(F.count_if(p & t).alias("tp"), F.count_if(t).alias("nt"), F.count_if(p).alias("np"), F.count_if(t & c & ~p).alias("missed"), F.count_if(t & ~c & ~p).alias("unseen"))
    n = ids.select("s1").distinct().join(n, "s1", "left").fillna(0)
    tp, nt, np_, missed, unseen = (F.col(x) for x in ("tp", "nt", "np", "missed", "unseen"))
    mean = lambda e, name: F.round(F.avg(e), 6).alias(name)
    return n.agg(
        mean(f05(tp, nt, np_), "f_now"), mean(f05(tp, nt, tp), "f_without_fp"), mean(f05(tp + missed + unseen, nt, np_ + missed + unseen), "f_without_fn"),
        mean(f05(tp + unseen, nt, np_ + unseen), "f_without_blocking_miss"), mean(f05(tp + missed, nt, tp + missed), "f_ceiling"),
    )


def entity_buckets(ids: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """bucket, n, loss over the six kinds of outcome."""
    df = entity_counts(ids, pred, truth)
    t, p, tp = F.col("n_true"), F.col("n_pred"), F.col("tp")
    kind = F.when((t == 0) & (p == 0), "singleton_ok").when(t == 0, "singleton_fp").when(p == 0, "matched_empty").when((tp == t) & (tp == p), "exact").when(tp < p, "has_fp").otherwise("only_fn")
    return df.groupBy(kind.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum(1 - F.col("f")), 6).alias("loss"))


def error_funnel(truth: DataFrame, cands: DataFrame, scored: DataFrame, owned: DataFrame, pred: DataFrame) -> DataFrame:
    """stage, n: true pairs lost at retrieval, prefilter, ownership and decision, and false positives."""
    key = ["s1", "cand"]
    left, parts = truth.select(*key).distinct(), []
    for name, kept in (("retrieval", cands), ("prefilter", scored), ("ownership", owned), ("decision", pred)):
        parts.append(left.join(kept.select(*key), key, "left_anti").agg(F.lit(name).alias("stage"), F.count("*").alias("n")))
        left = left.join(kept.select(*key), key, "left_semi")
    parts.append(pred.select(*key).distinct().join(truth.select(*key), key, "left_anti").agg(F.lit("false_positive").alias("stage"), F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def interventions(ids: DataFrame, pred: DataFrame, truth: DataFrame, cands: DataFrame) -> DataFrame:
    """intervention, macro_f05: the score if an oracle removed one class of error."""
    key = ["s1", "cand"]
    p, t = pred.select(*key).distinct(), truth.select(*key).distinct()
    cases = {"none": p, "drop_false_positives": p.join(t, key, "left_semi"), "add_seen_misses": p.unionByName(t.join(cands.select(*key), key, "left_semi")).distinct(), "add_all_misses": p.unionByName(t).distinct()}
    out = None
    for name, case in cases.items():
        one = macro_f05(ids, case, truth).select(F.lit(name).alias("intervention"), "macro_f05")
        out = one if out is None else out.unionByName(one)
    return out


def threshold_sweep(ids: DataFrame, scored: DataFrame, truth: DataFrame, grid: Sequence[float], score: str = "p") -> DataFrame:
    """t, macro_f05 for a grid of thresholds in one pass: every pair counts for the thresholds that it reaches.

    The grid is a short literal. Pairs are folded into one row for each s1 and step of the grid first.
    """
    ts = F.array(*[F.lit(float(t)) for t in grid])
    true = truth.select("s1", "cand", F.lit(1).alias("it")).distinct()
    n_true = true.groupBy("s1").agg(F.count("*").alias("n_true"))
    rows = scored.join(true, ["s1", "cand"], "left")
    step = F.size(F.filter(ts, lambda t: F.col(score) >= t))
    folded = rows.groupBy("s1", step.alias("steps")).agg(F.count("*").alias("n"), F.count("it").alias("tp"))
    lists = folded.groupBy("s1").agg(F.collect_list(F.struct("steps", "n", "tp")).alias("l"))
    df = ids.select("s1").distinct().join(n_true, "s1", "left").join(lists, "s1", "left").fillna(0, ["n_true"])
    df = df.select("n_true", F.coalesce("l", F.array().cast("array<struct<steps:int,n:bigint,tp:bigint>>")).alias("l"), F.posexplode(ts).alias("k", "t"))
    reach = F.filter("l", lambda x: x["steps"] > F.col("k"))
    total = lambda f: F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x[f])
    return df.groupBy("t").agg(F.round(F.avg(f05(total("tp"), F.col("n_true"), total("n"))), 6).alias("macro_f05"))


def score_bins(pairs: DataFrame, edges: Sequence[float] = (0.01, 0.05, 0.2, 0.5, 0.9), by: tuple[str, ...] = ()) -> DataFrame:
    """bin, n, mean score and match rate, apart for each value of the columns by; bin k holds scores from the k-th edge to the next. Null scores have a null bin."""
    b = sum((F.col("p") >= e).cast("long") for e in edges)
    return pairs.groupBy(b.alias("bin"), *by).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("match_rate"))


def log_loss(pairs: DataFrame) -> DataFrame:
    """One row: n, log_loss (scores clipped to 1e-7), accuracy at 0.5."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-7)), F.lit(1e-7))
    loss = F.when(F.col("y") == 1, -F.ln(p)).otherwise(-F.ln(1 - p))
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg(loss), 6).alias("log_loss"), F.round(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")), 6).alias("accuracy"))


def submission_diff(old: DataFrame, new: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row over two list tables (s1, matched): changed lists, added and removed ids, lists that became empty or filled.

    With groups (s1, country) one row for each country. Null lists are empty; an s1 that one table lacks does not count.
    """
    ids = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    both = old.select("s1", ids(F.col("matched")).alias("o")).join(new.select("s1", ids(F.col("matched")).alias("n")), "s1")
    size = lambda c: F.size(c).cast("long")
    rows = both.groupBy() if groups is None else both.join(groups.select("s1", "country").distinct(), "s1").groupBy("country")
    return rows.agg(
        F.count_if((F.size(F.array_except("o", "n")) > 0) | (F.size(F.array_except("n", "o")) > 0)).alias("changed"), F.sum(size(F.array_except("n", "o"))).alias("added"),
        F.sum(size(F.array_except("o", "n"))).alias("removed"), F.count_if((F.size("o") > 0) & (F.size("n") == 0)).alias("emptied"), F.count_if((F.size("o") == 0) & (F.size("n") > 0)).alias("filled"),
    )


def text_conflicts(rows: DataFrame) -> DataFrame:
    """Texts (key, label) that carry opposite labels: key, n, n_positive."""
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("n_positive")).where("n_positive > 0 and n_positive < n")


def stranded_owners(truth: DataFrame, scored: DataFrame, pred: DataFrame) -> DataFrame:
    """True pairs that lost their candidate to a rival who is rejected too: s1, cand, winner."""
    w = W.partitionBy("cand").orderBy(F.desc("p"), "s1")
    best = scored.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("s1").alias("winner"), "cand")
    lost = truth.select("s1", "cand").join(scored.select("s1", "cand"), ["s1", "cand"], "left_semi").join(best, "cand").where("winner <> s1")
    taken = pred.select(F.col("s1").alias("winner"), "cand")
    return lost.join(taken, ["winner", "cand"], "left_anti").select("s1", "cand", "winner")


def blocking_recall(truth: DataFrame, cands: DataFrame, legs: Sequence[str]) -> DataFrame:
    """leg, found, total, recall: of the union and of each leg (a column that is null where the leg missed the pair)."""
    t = truth.select("s1", "cand").distinct().join(cands.withColumn("__in", F.lit(1)), ["s1", "cand"], "left")
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("leg"), F.col(c).isNotNull().alias("hit")) for n, c in [("union", "__in"), *[(x, x) for x in legs]]])).alias("x")
    return t.select(stack).groupBy("x.leg").agg(F.count_if("x.hit").alias("found"), F.count("*").alias("total")).withColumn("recall", F.round(F.col("found") / F.col("total"), 6))


def verify_pairs(pairs: DataFrame) -> DataFrame:
    """One row of counts that must be 0: null keys, duplicate pairs, labels other than 0 and 1, scores outside [0, 1]; and n."""
    keys = pairs.groupBy("s1", "cand").agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("duplicates"))
    bad = pairs.agg(
        F.count("*").alias("n"), F.count_if(F.col("s1").isNull() | F.col("cand").isNull()).alias("null_keys"), F.count_if(~F.coalesce(F.col("y").isin(0, 1), F.lit(False))).alias("bad_labels"),
        F.count_if(~F.coalesce(F.col("p").between(0, 1) & ~F.isnan("p"), F.lit(False))).alias("bad_scores"),
    )
    return bad.join(F.broadcast(keys))


def paired_bootstrap(diffs: DataFrame, draws: int = 200, seed: str = "boot") -> DataFrame:
    """Of groups (stratum, grp, n, diff = summed difference) the mean difference and its 2.5 and 97.5 percentiles (linear).

    Each draw takes as many groups of every stratum as it has, with replacement; which ones follows from digests of seed, stratum,
    place and draw, so runs agree. Groups are whole states or names, one row each: draws times their number are summed, in
    parts. Null strata or groups raise nothing and count as groups of their own; without groups all values are null.
    """
    own = W.partitionBy("stratum")
    g = written(diffs.select("stratum", "n", "diff", (F.row_number().over(own.orderBy("grp")) - 1).cast("long").alias("i"), F.count("*").over(own).alias("m")), "groups")
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("stratum").cast("string"), "i", "draw")), 1, 13), 16, 10).cast("long") % F.col("m")
    picks = g.select("stratum", "i", "m", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("draw", F.col("stratum").alias("s"), pick.alias("pick"))
    held = picks.join(g, F.col("s").eqNullSafe(F.col("stratum")) & (F.col("pick") == F.col("i")))
    means = held.groupBy("draw").agg((F.sum("diff") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    whole = g.agg(F.round(F.sum("diff") / F.nullif(F.sum("n"), F.lit(0)), 8).alias("mean"))
    return whole.join(F.broadcast(means.agg(F.round(F.percentile("m", 0.025), 8).alias("low"), F.round(F.percentile("m", 0.975), 8).alias("high"))))


def whole_state_sample(states: DataFrame, target: int, cap: int, seed: str = "sample") -> DataFrame:
    """Whole states (country, state, n) in hash order, each at most cap, until target rows: country, state, n."""
    h = F.md5(F.concat_ws("|", F.lit(seed), "country", "state"))
    w = W.partitionBy("country").orderBy("h", "state").rowsBetween(W.unboundedPreceding, -1)
    df = states.where(F.col("n") <= cap).withColumn("h", h).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return df.where(F.col("before") < target).select("country", "state", "n")


def state_subsets(states: DataFrame, targets: dict[str, int], seed: str = "subset", many: int = 40) -> DataFrame:
    """Whole states (country, state, n) for several disjoint subsets of about the given sizes: country, state, n, subset.

    A country has its share of each target. Its states come in hash order; each fills the first subset, until that has
    what it wants, then the next; what is left over has no row. States of more than 0.6 times what the first subset wants (1.5 times in a
    country of fewer than `many` states) are passed over, so that a subset has several. One window of states for each country.
    """
    want, own = next(iter(targets.values())), W.partitionBy("country")
    total = states.agg(F.sum("n").alias("__all"))
    df = states.select("country", "state", "n").join(F.broadcast(total)).withColumn("__share", F.sum("n").over(own) / F.col("__all")).withColumn("__many", F.count("*").over(own) >= many)
    df = df.where(F.col("n") <= want * F.col("__share") * F.when(F.col("__many"), 0.6).otherwise(1.5))
    df = df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(seed), "country", "state"))).withColumn("subset", F.lit(None).cast("string"))
    for name, want in targets.items():
        open_ = F.col("subset").isNull()
        before = F.sum(F.when(open_, F.col("n")).otherwise(0)).over(own.orderBy("__h", "state").rowsBetween(W.unboundedPreceding, -1))
        df = df.withColumn("subset", F.when(open_ & (F.coalesce(before, F.lit(0)) < want * F.col("__share")), name).otherwise(F.col("subset")))
    return df.where("subset is not null").select("country", "state", "n", "subset")
