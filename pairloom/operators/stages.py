"""The two model stages from end to end: fit, score, decide, report. Only models, thresholds and short reports are on the driver.

Stage 1 scores pairs by their own features; stage 2 adds the context among the pairs that stage 1 leaves, and a tuned
decision rule. Pairs are (s1, cand, y, features ...), without repeats; ids lists the s1 that count, truth is (s1, cand).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from . import context as C
from . import decision as D
from . import evaluate as E
from . import models as M
from . import rules

# The least score that is kept, and the thresholds that are tried.
LEAST = 0.01
GRID = tuple(round(0.2 + 0.01 * i, 2) for i in range(77))
#: Columns that context adds whatever the channels.
CONTEXT = (
    "c_rank_s1", "c_pmax_s1", "c_psum_s1", "c_n05_s1", "c_n02_s1", "c_ncand_s1", "c_rank_cand", "c_nclaim", "c_pmax_cand", "c_pother_cand", "c_gap_s1", "c_margin_cand",
    "c_top_name", "c_top_addr", "c_top_house", "t_name_max", "t_addr_max", "t_name_mean", "t_addr_mean", "t_support", "t_house_agree", "t_n_others",
)


@dataclass
class Stage1:
    """Models, their features, the threshold of the best macro F0.5 on validation rows, and that value."""

    models: list
    features: tuple[str, ...]
    threshold: float
    value: float


def fit_stage1(train: DataFrame, valid: DataFrame, features: Sequence[str], ids: DataFrame, truth: DataFrame, grid: Sequence[float] = GRID, **options) -> Stage1:
    """A model of train that stops early on valid, and its threshold by a sweep over valid's pairs (one owner each)."""
    models = [M.fit_gbt(train, features, valid=valid, **options)]
    scored = D.one_to_one(M.score_gbt(models, valid, features))
    value, threshold = rules.best_of(E.threshold_sweep(ids, scored, truth, grid))
    return Stage1(models, tuple(features), threshold, value)


def score_stage1(stage: Stage1, pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs with p, those that reach `least` only: lower ones are never chosen, so nothing later carries them."""
    return M.score_gbt(stage.models, pairs, stage.features).where(F.col("p") >= least)


def choose_stage1(stage: Stage1, scored: DataFrame) -> DataFrame:
    """s1, cand by owner and threshold."""
    return D.select_threshold(D.one_to_one(scored), stage.threshold).select("s1", "cand")


@dataclass
class Stage2:
    """Seed-bagged models over features and context, the channels they know, and the tuned rule."""

    models: list
    features: tuple[str, ...]
    channels: tuple[str, ...]
    rule: rules.Rule


def _in_context(scored: DataFrame, attrs: DataFrame, similarity: Callable, channels: DataFrame | None, least: float) -> DataFrame:
    return C.build_context(scored, attrs, similarity, channels, least)


def fit_stage2(train: DataFrame, valid: DataFrame, features: Sequence[str], attrs: DataFrame, similarity: Callable, ids: DataFrame, truth: DataFrame, fold: DataFrame, channels: DataFrame | None = None, seeds: Sequence[int] = (42, 43, 44), least: float = LEAST, **options) -> Stage2:
    """Models of train in its context (p out of fold), one for each seed, and the decision rule tuned on valid; fold: s1, fold.

    channels: s1, cand and model scores, of both tables' pairs; null where a score is missing.
    """
    names = tuple(c for c in (channels.columns if channels is not None else ()) if c not in ("s1", "cand"))
    own = tuple(f"{C.CHANNELS[c]}_{x}" for c in names if c in C.CHANNELS for x in ("rank_s1", "gap_s1", "rank_cand", "margin_cand"))
    every = (*features, "p", *CONTEXT, *names, *own)
    with Scratch(train.sparkSession) as tmp:
        a, b = (tmp.written(_in_context(t, attrs, similarity, channels, least), "context") for t in (train, valid))
        models = M.fit_bagged(a, every, seeds, valid=b, **options)
        scored = tmp.written(M.score_gbt(models, b, every, "p2").select("s1", "cand", "y", F.col("p2").alias("p")), "scored")
        rule = rules.tune(scored, ids, truth, fold, **{k: v for k, v in options.items() if k in ("rounds", "depth")})
    return Stage2(models, every, names, rule)


def predict_stage2(stage: Stage2, scored: DataFrame, attrs: DataFrame, similarity: Callable, channels: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """s1, cand chosen of pairs that stage 1 scored (s1, cand, p, features ...). A channel that the models use must be there."""
    missing = sorted(set(stage.channels) - set(channels.columns if channels is not None else ()))
    if missing:
        raise ValueError(f"scores are missing: {', '.join(missing)}")
    in_context = _in_context(scored, attrs, similarity, channels, least)
    pairs = M.score_gbt(stage.models, in_context, stage.features, "__score").select("s1", "cand", F.col("__score").alias("p"))
    return rules.apply(stage.rule, pairs)


def country_report(ids: DataFrame, chosen: DataFrame) -> DataFrame:
    """Of ids (s1, country): country, n_s1, mean_matches, empty_rate. A country without labels should look like the others. Repeated pairs count once."""
    n = chosen.select("s1", "cand").distinct().groupBy("s1").agg(F.count("*").alias("__k"))
    rows = ids.select("s1", "country").distinct().join(n, "s1", "left").withColumn("__k", F.coalesce("__k", F.lit(0)))
    return rows.groupBy("country").agg(F.count("*").alias("n_s1"), F.round(F.avg("__k"), 6).alias("mean_matches"), F.round(F.avg((F.col("__k") == 0).cast("int")), 6).alias("empty_rate"))
