"""Audits and smaller operators: address diagnostics, blends, folds, calibration tables, invariants, reassignment, partitions.

Null texts count as empty. Ties break by the smaller key unless an operator says otherwise. Empty tables give empty results, or
one row of zeros where counts are asked. Names that begin with two underscores are reserved.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import Scratch, written
from . import decision as D
from .evaluate import f05, macro_f05


def address_patterns(address: Column) -> dict[str, Column]:
    """Diagnostics of one address: unit marker, compound number, five-digit postal code, no number at all."""
    s = F.lower(F.coalesce(address, F.lit("")))
    return {
        "unit_marker": s.rlike(r"\b(apt|apartment|suite|ste|unit|floor|room)\b"), "compound_number": s.rlike(r"\b[0-9]+\s*[-/]\s*[0-9a-z]+\b"),
        "us_zip": s.rlike(r"\b[0-9]{5}(-[0-9]{4})?\b"), "no_number": ~s.rlike("[0-9]"), "blank": F.trim(s) == "",
    }


def blank_flags(a: Column, b: Column) -> dict[str, Column]:
    """Whether the raw address of either side is blank; null is."""
    return {k: F.trim(F.coalesce(c, F.lit(""))) == "" for k, c in (("a", a), ("b", b))}


def first_number_conflict(a: Column, b: Column) -> Column:
    """Both addresses have a number, and their first ones differ."""
    first = lambda s: F.regexp_extract(F.coalesce(s, F.lit("")), "([0-9]+)", 1)
    return (first(a) != "") & (first(b) != "") & (first(a) != first(b))


def pattern_audit(rows: DataFrame, category: str, address: str) -> DataFrame:
    """For each category: n, and how many addresses show each pattern."""
    return rows.groupBy(category).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in address_patterns(F.col(address)).items()])


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """A stable bucket of a text, from its SHA-256 digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long") % buckets


def blend_sweep(ids: DataFrame, pairs: DataFrame, truth: DataFrame, alphas: Sequence[float], grid: Sequence[float]) -> DataFrame:
    """alpha, t, macro_f05 of (1 - alpha) * p2 + alpha * p with owners chosen anew for each alpha; one pass over both short grids."""
    true = truth.select("s1", "cand", F.lit(1).alias("it")).distinct()
    rows = pairs.select("s1", "cand", "p", "p2", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    rows = rows.withColumn("b", F.round((1 - F.col("alpha")) * F.col("p2") + F.col("alpha") * F.col("p"), 9))
    w = W.partitionBy("alpha", "cand").orderBy(F.desc("b"), "s1")
    own = rows.withColumn("r", F.row_number().over(w)).where("r = 1").join(true, ["s1", "cand"], "left")
    at = own.select("alpha", "s1", "it", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: F.col("b") >= t)).alias("t"))
    n = at.groupBy("alpha", "t", "s1").agg(F.count("*").alias("np"), F.count("it").alias("tp"))
    n_true = true.groupBy("s1").agg(F.count("*").alias("nt"))
    # ids without a prediction at a step score by their truth alone: summed once, corrected where something is predicted
    base = ids.select("s1").distinct().join(n_true, "s1", "left").fillna(0, ["nt"])
    total = base.agg(F.count("*").alias("n"), F.sum(F.when(F.col("nt") == 0, 1.0).otherwise(0.0)).alias("empty"))
    scored = n.join(base, "s1").withColumn("gain", f05(F.col("tp"), F.col("nt"), F.col("np")) - F.when(F.col("nt") == 0, 1.0).otherwise(0.0))
    gains = scored.groupBy("alpha", "t").agg(F.sum("gain").alias("gain"))
    steps = total.select("n", "empty", F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(t)).alias("t")) for a in alphas for t in grid])).alias("x")).select("n", "empty", "x.alpha", "x.t")
    return steps.join(gains, ["alpha", "t"], "left").select("alpha", "t", F.round((F.col("empty") + F.coalesce("gain", F.lit(0.0))) / F.col("n"), 6).alias("macro_f05"))


def interpolated(df: DataFrame, score: str, points: Sequence[tuple[float, float]], name: str = "q") -> DataFrame:
    """Piecewise-linear calibration over stored (x, y) breakpoints, clipped outside them."""
    xs, ys = zip(*sorted(points))
    p = F.col(score)
    out = F.when(p <= xs[0], F.lit(ys[0]))
    for a, b, u, v in zip(xs, xs[1:], ys, ys[1:]):
        out = out.when(p <= b, u + (p - a) * ((v - u) / (b - a) if b > a else 0.0))
    return df.withColumn(name, out.otherwise(F.lit(ys[-1])))


def fold_means(logits: DataFrame, folds: int) -> DataFrame:
    """s1, cand, logit, complete: mean over the folds' scores (s1, cand, fold, logit) and whether all folds are there."""
    return logits.groupBy("s1", "cand").agg(F.avg("logit").alias("logit"), (F.count_distinct("fold") == folds).alias("complete"))


def routed(pairs: DataFrame, by_fold: DataFrame) -> DataFrame:
    """pairs (s1, cand, fold; null: not trained on) with logit: of the model that did not see the pair's fold, else the mean.

    by_fold has s1, cand, fold (that the model left out) and logit.
    """
    mean = by_fold.groupBy("s1", "cand").agg(F.avg("logit").alias("__mean"))
    own = by_fold.select("s1", "cand", "fold", F.col("logit").alias("__own"))
    got = pairs.drop("logit").join(own, ["s1", "cand", "fold"], "left").join(mean, ["s1", "cand"], "left")
    return got.withColumn("logit", F.when(F.col("fold").isNull(), F.col("__mean")).otherwise(F.col("__own"))).drop("__mean", "__own")


def invariants(ids: DataFrame, lists: DataFrame) -> DataFrame:
    """One row of counts that must be 0: repeated s1, missing s1, unknown s1, candidates with two owners."""
    own = lists.select("s1", F.explode(F.filter(F.split("matched", ","), lambda x: x != "")).alias("cand"))
    counts = {
        "repeated": lists.groupBy("s1").count().where("count > 1"), "missing": ids.select("s1").distinct().join(lists, "s1", "left_anti"),
        "unknown": lists.join(ids, "s1", "left_anti"), "shared": own.groupBy("cand").agg(F.count_distinct("s1").alias("m")).where("m > 1"),
    }
    rows = None
    for k, df in counts.items():
        one = df.agg(F.lit(k).alias("check"), F.count("*").alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def paired_text_sample(rows: DataFrame, dev: int = 2, audit: int = 2) -> DataFrame:
    """Rows (a, b, label, origin) split without leaks: texts of opposite labels go; of equal texts the trusted origin
    stays; a text hash group is dev, audit or train as a whole."""
    w = W.partitionBy("a", "b").orderBy((F.col("origin") != "train").cast("int"), "origin", "label")
    mixed = W.partitionBy("a", "b")
    df = rows.withColumn("kinds", F.max("label").over(mixed) - F.min("label").over(mixed)).where("kinds = 0").withColumn("r", F.row_number().over(w)).where("r = 1").drop("kinds", "r")
    bucket = hash_bucket(F.col("a"))
    return df.withColumn("part", F.when((F.col("origin") == "train") & (bucket < dev), "dev").when((F.col("origin") == "train") & (bucket < dev + audit), "audit").when(bucket < dev + audit, None).otherwise("train")).where("part is not null")


def orphan_reassign(scored: DataFrame, chosen: DataFrame, rivals: DataFrame, margin: float = 0.0, floor: float = 0.05, most: int = 20) -> DataFrame:
    """Unused candidates to the rival whose exact expected F0.5 gains most, if by more than margin: s1, cand, gain.

    scored: s1, cand, q (calibrated, without repeated pairs). chosen: s1, cand, what is predicted already. rivals: s1, cand, the losing claims of candidates
    that nothing chose. An s1 is judged by its `most` best candidates by q, then cand, and all chosen ones; a
    claim counts if it is among them and its q reaches floor. Candidates are tried by descending q of their best claim, then cand;
    each compares the gains of all its rivals against what those have taken so far, and equal gains go to the greater s1.

    That sequence runs in rounds over written tables: a candidate is decided once it comes first among the
    undecided ones of every rival it has, so nothing undecided can change its gains. Null keys claim nothing; without rivals there are no rows.
    """
    kinds = dict(rivals.dtypes)
    with Scratch(scored.sparkSession) as tmp:
        taken = chosen.select("s1", "cand").distinct().withColumn("sel", F.lit(True))
        w = W.partitionBy("s1").orderBy(F.desc("q"), "cand")
        kept = scored.select("s1", "cand", "q").join(taken, ["s1", "cand"], "left").withColumn("r", F.row_number().over(w)).where((F.col("r") <= most) | F.col("sel"))
        kept = tmp.written(kept.select("s1", "cand", "q", F.coalesce("sel", F.lit(False)).alias("sel")), "kept")
        edges = rivals.select("s1", "cand").distinct().join(kept.where(F.col("q") >= floor).select("s1", "cand", "q"), ["s1", "cand"]).join(taken.select("cand").distinct(), "cand", "left_anti")
        edges = tmp.written(edges.withColumn("top", F.max("q").over(W.partitionBy("cand"))), "edges0")
        state = kept.join(edges.select("s1").distinct(), "s1", "left_semi").groupBy("s1").agg(F.collect_list(F.struct("cand", "q", "sel")).alias("l"))
        state, out, k = tmp.written(state, "state0"), None, 0
        of = lambda l, c: F.filter(l, c)
        while not edges.isEmpty():
            place = F.struct((-F.col("top")).alias("t"), "cand")
            first = edges.withColumn("first", F.min(place).over(W.partitionBy("s1")) == place)
            ready = first.groupBy("cand").agg(F.min("first").alias("ready"), F.collect_list("s1").alias("claims")).where("ready").select("cand", F.explode("claims").alias("s1"))
            chances = lambda keep: F.transform(of(F.col("l"), keep), lambda x: x["q"])
            now = D.expected_f(chances(lambda x: x["sel"]), chances(lambda x: ~x["sel"]))
            then = D.expected_f(chances(lambda x: x["sel"] | (x["cand"] == F.col("cand"))), chances(lambda x: ~x["sel"] & (x["cand"] != F.col("cand"))))
            gains = ready.join(state, "s1").select("cand", "s1", F.round(then - now, 12).alias("gain"))
            best = tmp.written(gains.groupBy("cand").agg(F.max(F.struct("gain", "s1")).alias("b")).select("cand", "b.s1", "b.gain"), f"best{k}")
            new = best.where(F.col("gain") > margin)
            out = new if out is None else out.unionByName(new)
            # an s1 has one first candidate, so it takes one of a round at most
            more = new.select("s1", F.col("cand").alias("more"))
            state = tmp.written(state.join(more, "s1", "left").select("s1", F.transform("l", lambda x: F.struct(x["cand"].alias("cand"), x["q"].alias("q"), (x["sel"] | F.coalesce(x["cand"] == F.col("more"), F.lit(False))).alias("sel"))).alias("l")), f"state{k + 1}")
            edges = tmp.written(edges.join(best.select("cand"), "cand", "left_anti"), f"edges{k + 1}")
            k += 1
            tmp.drop(f"state{k - 1}", f"edges{k - 1}")
        if out is None:
            return scored.sparkSession.createDataFrame([], f"s1 {kinds['s1']}, cand {kinds['cand']}, gain double")
        return written(out.select("s1", "cand", "gain"), "reassigned")


def choose_margin(scored: DataFrame, chosen: DataFrame, rivals: DataFrame, ids: DataFrame, truth: DataFrame, margins: Sequence[float] = (0.0, 0.002, 0.01)) -> tuple[float | None, dict[float, float]]:
    """The margin of orphan_reassign by macro F0.5 over ids (s1), the greatest of equals, or None if none beats `chosen`; and the value of each."""
    before = macro_f05(ids, chosen, truth).first()["macro_f05"]
    values = {m: macro_f05(ids, chosen.select("s1", "cand").unionByName(orphan_reassign(scored, chosen, rivals, m).select("s1", "cand")), truth).first()["macro_f05"] for m in margins}
    best = max(values, key=lambda m: (values[m], m))
    return (best if values[best] > before else None), values


SHARES, LEAST = (0.2, 0.3, 0.5), (0.1, 0.1, 0.25)


def _enumerated(rows: list[dict], shares: Sequence[float]) -> list[int] | None:
    """Parts of 5 to 10 groups, in the order of their names: of all assignments with 1, 2 and 2 groups and LEAST of the rows at
    least, that of the least squared distance from the shares, the first of equals. None if there is none."""
    if len(shares) != 3 or not 5 <= len(rows) <= 10:
        return None
    tries = np.array(list(itertools.product(range(3), repeat=len(rows))))
    counts = np.array([r["n"] for r in rows])
    total = counts.sum()
    sizes = np.stack([(tries == j) @ counts for j in range(3)], axis=1)
    enough = (sizes >= np.array(LEAST) * total).all(axis=1) & np.all([(tries == j).sum(axis=1) >= m for j, m in enumerate((1, 2, 2))], axis=0)
    if not enough.any():
        return None
    cost = np.where(enough, np.square(sizes / total - np.array(shares)).sum(axis=1), np.inf)
    return tries[cost.argmin()].tolist()


def _by_size(rows: list[dict], shares: Sequence[float]) -> list[int]:
    """Parts of groups, largest first (equal ones by the digest of their name), each to the part that lacks the greatest share of what it should have."""
    want = np.array(shares) * sum(r["n"] for r in rows)
    held, out = np.zeros(len(shares)), [0] * len(rows)
    for k in sorted(range(len(rows)), key=lambda k: (-rows[k]["n"], hashlib.sha256(str(rows[k]["grp"]).encode()).hexdigest())):
        out[k] = int(np.argmax((want - held) / want))
        held[out[k]] += rows[k]["n"]
    return out


def dealt_groups(groups: DataFrame, shares: Sequence[float] = SHARES, ways: str = "both") -> DataFrame:
    """Whole groups (country, grp, n) to parts 0, 1, ... of about the given shares: country, grp, n, part. One table of groups for each country.

    ways: enumerate (three parts of 5 to 10 groups; other countries, or those without a balanced assignment, get null parts), size, or
    both, which turns to size where enumeration finds nothing. Null groups count as one, named None; n is positive.
    """

    def deal(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: "" if r["grp"] is None else str(r["grp"]))
        out = _enumerated(rows, shares) if ways != "size" else None
        if out is None:
            out = [None] * len(rows) if ways == "enumerate" else _by_size(rows, shares)
        return pa.table([pa.array([r[c] for r in rows], t.schema.field(c).type) for c in ("country", "grp", "n")] + [pa.array(out, pa.int32())], names=["country", "grp", "n", "part"])

    kinds = dict(groups.dtypes)
    return groups.select("country", "grp", "n").groupBy("country").applyInArrow(deal, f"country {kinds['country']}, grp {kinds['grp']}, n {kinds['n']}, part int")


def greedy_partition(groups: DataFrame, shares: Sequence[float] = SHARES) -> DataFrame:
    """dealt_groups by enumeration where that is possible, else by size."""
    return dealt_groups(groups, shares)


def partition(info: DataFrame, shares: Sequence[float] = SHARES, least: Sequence[float] = LEAST) -> DataFrame:
    """Records (entity_id, country, state, name_core) to parts by whole states, or by whole names where a country's states cannot balance: entity_id, country, grp, part.

    Null states and names count as empty; a record without a name is a group of its own. Repeated ids, fewer than ten names
    where names are needed, and a part with less than its least share of a country's records raise ValueError.
    """
    with Scratch(info.sparkSession) as tmp:
        empty = lambda c: F.coalesce(F.col(c), F.lit(""))
        rows = tmp.written(info.select("entity_id", "country", F.concat(F.lit("state:"), empty("state")).alias("state"), F.when(empty("name_core") == "", F.concat(F.lit("id:"), "entity_id")).otherwise(F.concat(F.lit("name:"), "name_core")).alias("name")), "records")
        if not rows.groupBy("entity_id").count().where("count > 1").isEmpty():
            raise ValueError("repeated entity_id")
        size = lambda c: rows.groupBy("country", F.col(c).alias("grp")).agg(F.count("*").alias("n"))
        states = tmp.written(dealt_groups(size("state"), shares, "enumerate"), "states")
        by_name = tmp.written(states.where("part is null").select("country").distinct(), "by_name")
        names = tmp.written(size("name").join(by_name, "country", "left_semi"), "names")
        few = names.groupBy("country").count().where("count < 10").first()
        if few:
            raise ValueError(f"{few.country}: fewer than ten names")
        parts = tmp.written(states.where("part is not null").unionByName(dealt_groups(names, shares, "size")), "parts")
        total = F.sum("n").over(W.partitionBy("country"))
        small = parts.groupBy("country", "part").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / total)
        floor = F.element_at(F.array(*[F.lit(float(x)) for x in least]), F.col("part") + 1)
        short = small.groupBy("country").agg(F.count("*").alias("parts"), F.min(F.col("share") - floor).alias("spare")).where((F.col("parts") < len(least)) | (F.col("spare") < 0)).first()
        if short:
            raise ValueError(f"{short.country}: no balanced parts")
        grp = F.when(F.col("by") == 1, F.col("name")).otherwise(F.col("state"))
        named = rows.join(by_name.withColumn("by", F.lit(1)), "country", "left").select("entity_id", "country", grp.alias("grp"))
        return written(named.join(parts.select("country", "grp", "part"), ["country", "grp"]).select("entity_id", "country", "grp", "part"), "partition")


def calibration_folds(info: DataFrame) -> DataFrame:
    """Two folds of whole names within each country of (entity_id, country, name_core): entity_id, country, fold.

    Largest names first, equal ones by the digest of their name, each to the smaller fold; a fold under a fifth of a country raises.
    """
    name = F.when(F.coalesce("name_core", F.lit("")) == "", F.concat(F.lit("id:"), "entity_id")).otherwise(F.col("name_core"))
    rows = info.select("entity_id", "country", name.alias("grp"))
    folds = written(dealt_groups(rows.groupBy("country", "grp").agg(F.count("*").alias("n")), (0.5, 0.5), "size"), "folds")
    small = folds.groupBy("country").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("part") == 0, F.col("n")).otherwise(0)).alias("a")).where("least(a, n - a) < 0.2 * n").first()
    if small:
        raise ValueError(f"{small.country}: no balanced folds")
    return rows.join(folds.select("country", "grp", F.col("part").alias("fold")), ["country", "grp"]).select("entity_id", "country", "fold")


def promote(comparison: DataFrame, least: float = 0.0002) -> DataFrame:
    """comparison (gain, ci_low, worst_country) with promoted: enough gain, a sure sign, and no country that loses."""
    return comparison.withColumn("promoted", (F.col("gain") >= least) & (F.col("ci_low") > 0) & (F.col("worst_country") >= 0))
