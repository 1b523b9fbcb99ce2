"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Method. A document is the set of the n-grams (ORDERS) of its shape, in which each character stands for its
class: vowels, consonants, capitals, digits, other letters, white space, and each ASCII mark for
itself, and of its words as far as they repeat (RUNS). Indicators are scaled by the log ratio of the n-gram's smoothed frequency among good and bad
documents, and normalised to length one; a linear hinge-loss model is fitted to them by dual
coordinate descent. A logistic curve, fitted on labelled rows that the model has not seen, turns margins into scores.

Training takes at most TRAIN_ROWS labelled doc_ids (those of the smallest digests), of each the row of the least n-gram set, and only
labels and texts; the largest thing that reaches the driver is their n-gram sets, at most
TRAIN_ROWS * DIMENSIONS numbers. Scoring is one pass without a shuffle.

Defined results. Null and empty texts have no n-grams: their score is the model's bias alone. Labels of
other values than 0 and 1 are ignored; of a doc_id with several labels the smallest counts. With one
class only, or no labels, every score is the share of label 1 (0.5 without labels). Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, minhash

ORDERS = (1, 2, 3)
CLASSES = 64
#: A word that follows itself gives n-grams of one word; the longest such run is indicated at these lengths.
RUNS = (2, 3, 4, 6, 8, 12)
DIMENSIONS = sum(CLASSES**n for n in ORDERS) + len(RUNS)
TRAIN_ROWS = 6_000
COST, EPOCHS, SMOOTH = 1.0, 12, 1.0
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 2, 3, 4
for _c in b"aeiou":
    _KIND[_c] = 1
_KIND[192:256] = 5
_KIND[128:192] = 6
_KIND[32], _KIND[10], _KIND[[9, 11, 12, 13]] = 7, 8, 9
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _KIND[_c] = 10 + _k


def grams(data: np.ndarray, run: int) -> np.ndarray:
    """The distinct n-grams of one text's bytes and its longest run of one word, as positions among DIMENSIONS, sorted."""
    kind = _KIND[data].astype(np.int64)
    kind = kind[kind != 6]  # the rest of a character that its first byte stands for
    base, code, out = 0, np.zeros(len(kind), np.int64), []
    for n in ORDERS:
        if n == 1:
            code = kind
        else:
            code = code[: len(code) - 1] * CLASSES + kind[n - 1 :] if len(code) > 1 else code[:0]
        seen = np.zeros(CLASSES**n, bool)
        seen[code] = True
        out.append(np.flatnonzero(seen) + base)
        base += CLASSES**n
    out.append(base + np.flatnonzero(run >= np.array(RUNS)))
    return np.concatenate(out)


def gram_sets(col) -> list[np.ndarray]:
    """The n-gram set of each text of an Arrow string array."""
    data, off = common.column_bytes(col)
    h, w = minhash.word_hashes(col)
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[w[:-1][w[:-1] < len(h)]] = True
    begin = np.flatnonzero(fresh)
    length = np.diff(np.r_[begin, len(h)])
    own = np.searchsorted(begin, w)
    runs = [int(length[a:b].max()) if b > a else 0 for a, b in zip(own[:-1], own[1:])]
    return [grams(data[off[k] : off[k + 1]], runs[k]) for k in range(len(col))]


class Model:
    """weight: the hinge model's weights times the log ratios; a, b: the logistic curve."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, a: float, b: float):
        self.ratio, self.weight, self.bias, self.a, self.b = ratio, weight, bias, a, b

    def margin(self, g: np.ndarray) -> float:
        r = self.ratio[g]
        norm = math.sqrt(float(r @ r)) or 1.0
        return float(self.weight[g] @ r) / norm + self.bias

    def score(self, g: np.ndarray) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.a * self.margin(g) + self.b))))


def log_ratios(sets: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    count = [np.full(DIMENSIONS, SMOOTH), np.full(DIMENSIONS, SMOOTH)]
    for g, y in zip(sets, labels):
        count[int(y)][g] += 1
    return (np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())).astype(np.float32)


def dual_descent(sets: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent; each class has half of the cost. The bias is a constant feature."""
    rows = []
    for g in sets:
        r = ratio[g]
        rows.append(r / (math.sqrt(float(r @ r)) or 1.0))
    sign = np.where(labels == 1, 1.0, -1.0)
    share = {s: len(sign) / (2.0 * max(1, int((sign == s).sum()))) for s in (1.0, -1.0)}
    top = [COST * share[s] for s in sign]
    weight, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            g, x, s = sets[k], rows[k], sign[k]
            slope = s * (float(weight[g] @ x) + bias) - 1.0
            new = min(max(alpha[k] - slope / 2.0, 0.0), top[k])  # x has length one, and so has the constant
            step = (new - alpha[k]) * s
            if step:
                alpha[k] = new
                weight[g] += step * x
                bias += step
    return weight.astype(np.float32), bias


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of labels on margins, by Newton's method, lightly regularised."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w, d = p * (1 - p) + 1e-9, p - labels
        h = np.array([[w @ margins**2 + 1e-2, w @ margins], [w @ margins, w.sum() + 1e-2]])
        step = np.linalg.solve(h, np.array([d @ margins + 1e-2 * (a - 1), d.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (a, b) if a > 0 else (1.0, b)


def fit(sets: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model from n-gram sets and labels; every fifth row of each class is left for the curve."""
    if len(set(labels.tolist())) < 2:
        p = float(labels.mean()) if len(labels) else 0.5
        z = np.zeros(DIMENSIONS, np.float32)
        return Model(z, z, 0.0, 1.0, math.log((p + 1e-6) / (1 - p + 1e-6)))
    rank = np.zeros(len(labels), np.int64)
    for y in (0, 1):
        rank[labels == y] = np.arange((labels == y).sum())
    train = rank % 5 != 4
    own = [g for g, t in zip(sets, train) if t]
    ratio = log_ratios(own, labels[train])
    weight, bias = dual_descent(own, labels[train], ratio)
    model = Model(ratio, weight, bias, 1.0, 0.0)
    held = ~train if (~train).any() and len(set(labels[~train].tolist())) == 2 else train
    margins = np.array([model.margin(g) for g, t in zip(sets, held) if t])
    model.a, model.b = _curve(margins, labels[held].astype(float))
    return model


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [g.astype(np.int32) for g in gram_sets(b.column("text"))]
        yield pa.record_batch([b.column("doc_id"), b.column("quality"), pa.array(sets, pa.list_(pa.int32()))], names=["doc_id", "quality", "grams"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents: docs (doc_id, text), labels (doc_id, quality); the doc_ids of the smallest digests.

    One row of each doc_id, that of the least n-gram set: at most `rows` sets reach the driver however often a doc_id repeats.
    """
    own = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    with common.Scratch(docs.sparkSession) as tmp:
        picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text")).join(F.broadcast(tmp.written(own, "labels")), "doc_id")
        sets = picked.select("doc_id", "quality", "text").mapInArrow(_gram_rows, "doc_id long, quality int, grams array<int>")
        got = sets.groupBy("doc_id", "quality").agg(F.min("grams").alias("grams")).toArrow()
    got = got.take(pa.array(np.argsort(got["doc_id"].to_numpy().astype(np.int64))))
    col = got["grams"].combine_chunks()
    flat, off = col.flatten().to_numpy(), np.r_[0, np.cumsum(col.value_lengths().to_numpy())].astype(np.int64)
    sets = [flat[off[k] : off[k + 1]] for k in range(len(col))]
    order = sorted(range(len(sets)), key=lambda k: (zlib.crc32(sets[k].tobytes()), k))  # by content, not by doc_id
    return fit([sets[k] for k in order], np.array(got["quality"].to_pylist(), np.int64)[order])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column name, the score; only texts go to Python, in Arrow batches."""

    @F.arrow_udf("double")
    def of(col: pa.Array) -> pa.Array:
        return pa.array([model.score(g) for s in range(0, len(col), 256) for g in gram_sets(col.slice(s, 256))], pa.float64())

    return docs.withColumn(name, of(common.whole_text(text)))


def held_out():
    """Rows that never train: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op7_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: quality scores of all documents."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(~held_out()))
    got = score(docs, model)
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
