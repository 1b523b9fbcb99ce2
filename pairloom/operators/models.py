"""Model fitting with pyspark.ml: gradient-boosted trees over imputed features, folds by group, isotonic calibration.

Missing features are nulls; every feature gets the value 0 and an indicator column instead, since pyspark.ml
takes no NaN. Names that begin with two underscores are reserved; all other columns pass through. An empty table scores to an
empty one, but none can be fitted on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def with_vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with features: values with nulls as 0, and their indicators."""
    flat = df.withColumns({f"__v_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in features} | {f"__m_{c}": F.col(c).isNull().cast("double") for c in features})
    names = [f"__{k}_{c}" for c in features for k in ("v", "m")]
    return VectorAssembler(inputCols=names, outputCol="__features").transform(flat).drop(*names)


def fit_gbt(df: DataFrame, features: Sequence[str], label: str = "y", weight: str | None = None, rounds: int = 20, depth: int = 5, seed: int = 42, valid: DataFrame | None = None, tolerance: float = 0.01):
    """Boosted trees over df. With valid, rounds end as soon as the loss on its rows falls by less than `tolerance` of itself."""
    extra = {"weightCol": weight} if weight else {}
    columns = [*features, label, *([weight] if weight else [])]
    rows = df.select(*columns)
    if valid is not None:
        rows = rows.withColumn("__valid", F.lit(False)).unionByName(valid.select(*columns).withColumn("__valid", F.lit(True)))
        extra |= {"validationIndicatorCol": "__valid", "validationTol": tolerance}
    return GBTClassifier(labelCol=label, featuresCol="__features", maxIter=rounds, maxDepth=depth, seed=seed, subsamplingRate=0.8, **extra).fit(with_vector(rows, features))


def fit_bagged(df: DataFrame, features: Sequence[str], seeds: Sequence[int] = (42, 43, 44), **options) -> list:
    """One model for each seed; score_gbt averages them."""
    return [fit_gbt(df, features, seed=k, **options) for k in seeds]


def importance(models: Sequence, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by their mean share of the models' gain, value and missing indicator together, greatest first."""
    mean = sum(m.featureImportances.toArray() for m in models) / len(models)
    return sorted(((f, float(mean[2 * k] + mean[2 * k + 1])) for k, f in enumerate(features)), key=lambda x: (-x[1], x[0]))


def score_gbt(models: Sequence, df: DataFrame, features: Sequence[str], name: str = "p") -> DataFrame:
    """df with the mean probability of one or several models."""
    out, columns = with_vector(df, features), []
    for k, m in enumerate(models):
        out = m.transform(out).withColumn(f"__p{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        columns.append(f"__p{k}")
    return out.withColumn(name, sum(F.col(c) for c in columns) / len(columns)).drop("__features", *columns)


def group_fold(group: Column, folds: int = 2) -> Column:
    """A fold for whole groups, from a check sum."""
    return (F.crc32(group.cast("string").cast("binary")) % folds).cast("int")


def out_of_fold(df: DataFrame, features: Sequence[str], fold: str = "fold", folds: int = 2, **options) -> DataFrame:
    """df with p, each row scored by the model that did not see its fold."""
    out = None
    for k in range(folds):
        model = fit_gbt(df.where(F.col(fold) != k), features, **options)
        part = score_gbt([model], df.where(F.col(fold) == k), features)
        out = part if out is None else out.unionByName(part)
    return out


def fit_isotonic(df: DataFrame, score: str = "p", label: str = "y"):
    """Isotonic calibration; IsotonicRegression clips outside its range and interpolates inside."""
    rows = df.select(F.col(score).cast("double").alias("__x"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression(featuresCol="__x", labelCol="label").fit(rows)


def calibrate(model, df: DataFrame, score: str = "p", name: str = "q") -> DataFrame:
    return model.setPredictionCol("__q").transform(df.withColumn("__x", F.col(score).cast("double"))).withColumn(name, F.col("__q")).drop("__x", "__q")


def calibrate_by_group(train: DataFrame, df: DataFrame, group: str, score: str = "p", label: str = "y", least: int = 200, name: str = "q") -> DataFrame:
    """df calibrated separately where the boolean `group` holds and where it does not, each part by its own fit if train has
    `least` rows and both labels there, else by the fit on all of train. Null counts as not holding."""
    flag = F.coalesce(F.col(group), F.lit(False))
    counts = {r["g"]: r for r in train.groupBy(flag.alias("g")).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).collect()}
    whole, out = fit_isotonic(train, score, label), None
    for g in (False, True):
        own = g in counts and counts[g]["n"] >= least and counts[g]["k"] == 2
        part = calibrate(fit_isotonic(train.where(flag == g), score, label) if own else whole, df.where(flag == g), score, name)
        out = part if out is None else out.unionByName(part)
    return out


def logit(p: Column, eps: float = 1e-6) -> Column:
    c = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(c / (1 - c))


def match_logit(no: Column | None, yes: Column) -> Column:
    """The logit of a match from a classifier with one output, or from both of two."""
    return yes if no is None else yes - no


def logit_features(p: Column, blank: Column, model_logit: Column | None = None) -> dict[str, Column]:
    """What logistic fusion sees: the logit of p, whether an address is blank, a model's logit (clipped to 20, quartered) and its product with the flag."""
    flag = F.coalesce(blank.cast("double"), F.lit(0.0))
    out = {"lf_logit": logit(p), "lf_blank": flag}
    if model_logit is not None:
        score = F.greatest(F.least(model_logit, F.lit(20.0)), F.lit(-20.0)) / 4
        out |= {"lf_model": score, "lf_both": score * flag}
    return out


def blended(a: Column, b: Column, share: float = 0.75) -> Column:
    """share of one score and the rest of the other; the one that is there where the other is null."""
    return F.coalesce(share * a + (1 - share) * b, a, b)


def switched(flag: Column, a: Column, b: Column) -> Column:
    """One score where the flag holds, else (null too) the other."""
    return F.when(flag, a).otherwise(b)


def pair_band(pairs: DataFrame, left: DataFrame, right: DataFrame, low: float, high: float, least: float = 0.01) -> DataFrame:
    """Pairs whose p lies in [max(low, least), high), with the texts of both sides (id, text) as a and b: what a text model is asked.

    Pairs of records without a text row are left out; other columns of pairs pass through.
    """
    band = pairs.where((F.col("p") >= max(low, least)) & (F.col("p") < high))
    a, b = left.select(F.col("id").alias("s1"), F.col("text").alias("a")), right.select(F.col("id").alias("cand"), F.col("text").alias("b"))
    return band.drop("a", "b").join(a, "s1").join(b, "cand").select(*[c for c in pairs.columns if c not in ("a", "b")], "a", "b").where("a is not null and b is not null")


def fit_fusion(df: DataFrame, features: Sequence[str], label: str = "y"):
    """Logistic fusion of logits and flags."""
    return LogisticRegression(labelCol=label, featuresCol="__features", maxIter=50, regParam=1e-4).fit(with_vector(df, features))


def stratified_sample(df: DataFrame, stratum: Column, shares: dict[str, int], seed: str = "strata") -> DataFrame:
    """Up to shares[s] rows of each stratum in hash order of (s1, cand); strata without a share are left out."""
    h = F.md5(F.concat_ws("|", F.lit(seed), "s1", "cand"))
    w = W.partitionBy("__s").orderBy("__h", "s1", "cand")
    rows = df.withColumn("__s", stratum).withColumn("__h", h).withColumn("__r", F.row_number().over(w))
    limit = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    return rows.where(F.col("__r") <= F.coalesce(F.try_element_at(limit, F.col("__s")), F.lit(0))).drop("__s", "__h", "__r")
