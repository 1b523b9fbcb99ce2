"""The choice among decision rules: thresholds, gates and exact expected F0.5, compared on cross-fitted scores."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from . import decision as D
from . import evaluate as E
from . import models as M

# The grids of thresholds and gates.
THRESHOLDS = tuple(round(0.2 + 0.02 * i, 2) for i in range(39))
GATES = tuple(round(0.1 + 0.05 * i, 2) for i in range(17))
GATE_FEATURES = ("g_p1", "g_p2", "g_p3", "g_sum", "g_n05", "g_n02", "g_n", "g_lost")


@dataclass
class Rule:
    """A tuned rule: its name, its threshold and gate level, the models fitted on all tuning rows, the value of each rule."""

    name: str
    threshold: float
    level: float
    gate: GBTClassificationModel
    calibration: IsotonicRegressionModel
    values: dict[str, float]

    def save(self, spark: SparkSession, path: str) -> None:
        self.gate.write().overwrite().save(f"{path}/gate")
        self.calibration.write().overwrite().save(f"{path}/calibration")
        text = json.dumps({"name": self.name, "threshold": self.threshold, "level": self.level, "values": self.values})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rule")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Rule:
        parts = json.loads(spark.read.text(f"{path}/rule").first()["value"])
        return Rule(gate=GBTClassificationModel.load(f"{path}/gate"), calibration=IsotonicRegressionModel.load(f"{path}/calibration"), **parts)


def _selected(name: str, kept: DataFrame, gate: DataFrame | None, threshold: float, level: float) -> DataFrame:
    """s1, cand chosen of owned pairs (s1, cand, p, q) by one rule; gate: s1, gate."""
    if name == "threshold":
        return D.select_threshold(kept, threshold).select("s1", "cand")
    if name == "gate+threshold":
        return D.gated(D.select_threshold(kept, threshold), gate, level).select("s1", "cand")
    return D.expected_f_exact(kept.select("s1", "cand", F.col("q").alias("p")), gate if name == "exact+gate" else None).select("s1", "cand")


def best_of(sweep: DataFrame) -> tuple[float, float]:
    """Value and place of the first maximum of a sweep (t, macro_f05), one row for each point of the grid."""
    top = sweep.orderBy(F.desc("macro_f05"), "t").first()
    return top["macro_f05"], top["t"]


def tune(pairs: DataFrame, ids: DataFrame, truth: DataFrame, fold: DataFrame, **options) -> Rule:
    """The rule of the best macro F0.5 over pairs (s1, cand, p, y), fold (s1, fold 0 or 1; 0 where missing).

    Gate and calibration that the rules are compared with never saw the s1's fold; the returned models are fitted on
    all rows. Of equal rules the first stays. The driver receives one row for each point of the grids.
    """
    with Scratch(pairs.sparkSession) as tmp:
        return _tuned(pairs, ids, truth, fold, tmp, options)


def _tuned(pairs: DataFrame, ids: DataFrame, truth: DataFrame, fold: DataFrame, tmp: Scratch, options: dict) -> Rule:
    """What four comparisons read is written once: owned pairs with their calibrated scores, and gates."""
    kept = tmp.written(D.one_to_one(pairs).join(fold, "s1", "left").fillna(0, ["fold"]), "owned")
    table = D.s1_table(pairs).join(pairs.groupBy("s1").agg(F.max("y").alias("y")), "s1").join(fold, "s1", "left").fillna(0, ["fold"])
    table = tmp.written(table, "table")
    gate = tmp.written(M.out_of_fold(table, GATE_FEATURES, **options).select("s1", F.col("p").alias("gate")), "gates")
    parts = [M.calibrate(M.fit_isotonic(kept.where(F.col("fold") != k)), kept.where(F.col("fold") == k)) for k in (0, 1)]
    kept = tmp.written(parts[0].unionByName(parts[1]), "calibrated")
    values = {}
    values["threshold"], threshold = best_of(E.threshold_sweep(ids, kept, truth, THRESHOLDS))
    strong = D.select_threshold(kept, threshold).join(gate, "s1")
    values["gate+threshold"], level = best_of(E.threshold_sweep(ids, strong, truth, GATES, score="gate"))
    for name in ("exact", "exact+gate"):
        values[name] = E.macro_f05(ids, _selected(name, kept, gate, threshold, level), truth).first()["macro_f05"]
    return Rule(max(values, key=values.get), threshold, level, M.fit_gbt(table, GATE_FEATURES, **options), M.fit_isotonic(kept), values)


def apply(rule: Rule, pairs: DataFrame) -> DataFrame:
    """s1, cand that a tuned rule chooses of pairs (s1, cand, p)."""
    kept = D.one_to_one(pairs)
    gate = M.score_gbt([rule.gate], D.s1_table(pairs), GATE_FEATURES, "gate").select("s1", "gate") if "gate" in rule.name else None
    if rule.name.startswith("exact"):
        kept = M.calibrate(rule.calibration, kept)
    return _selected(rule.name, kept, gate, rule.threshold, rule.level)
