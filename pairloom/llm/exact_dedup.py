"""Exact deduplication by distributed most-significant-digit radix partitioning.

Method. A text is read as the digit string (its byte length, then its bytes in order). Groups of
texts are split by successive digits until a group is a single text or its texts have ended; texts
that end together are equal. No digest takes part in equality (text_sha256 is output only).

1. Within a block of about common.BLOCK_BYTES of one input partition, the recursion runs to its end
   (radix_classes); one representative of each class goes on, with its count. A group of copies
   that holds a third of all rows thus sends one text per block.
2. Representatives are partitioned by their leading digits (length and WIDTHS[0] bytes). Digit groups of
   more than MAX_GROUP_BYTES (at most one for as many bytes of input, known by a hash of their digits, so their
   list may be broadcast) are split by more bytes, again and again, at last by all of them; then
   they have ended: each is one class, and partial sums do. All others fit into a task, which finishes the recursion.
3. Every row is joined to what its representative's class has become; an ended class that many blocks
   hold is dealt into parts (common.hot_join).

Defined results. Null text is empty; empty texts are equal to one another. Repeated rows count as
members. keep_id is the smallest doc_id that isn't null (null if a class has none); exactly one row
of a class has kept = true. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_GROUP_BYTES = 64 << 20
#: Stands for a missing doc_id where the smallest is sought.
NONE = 2**63 - 1
#: Leading bytes that a digit group is known by, on each level of the distributed recursion; then the whole text.
WIDTHS = (32, 256, 2_048, 16_384)
LOCAL = "doc_id long, rid long, rep long, text_sha256 string, n_local long, min_doc long, keep_rid long, len long, lead binary, body binary"
CLASSES = "rep long, keep_id long, keep_rid long, group_size long"


def normalised(col: str = "text"):
    """Each run of ASCII white space as one space; single spaces need no work."""
    return F.regexp_replace(common.whole_text(col), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def radix_classes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each of n texts (bytes, n + 1 offsets) the index of the first text that equals it.

    Level 0 splits by length, level k by the k-th eight bytes. Groups that are single or ended leave.
    """
    size, n = np.diff(off), len(off) - 1
    rep = np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rows, group = rep.copy(), size.copy()
    at = 0
    while len(rows):
        order = np.lexsort((rows, group))
        rows, group = rows[order], group[order]
        fresh = np.r_[True, group[1:] != group[:-1]]
        label = np.cumsum(fresh) - 1
        many = np.bincount(label)[label] > 1
        rows, label = rows[many], label[many]
        if not len(rows):
            break
        ended = size[rows] <= at
        if ended.any():
            first = np.r_[True, label[1:] != label[:-1]]
            heads = rows[first][np.cumsum(first) - 1]
            rep[rows[ended]] = heads[ended]
            rows, label = rows[~ended], label[~ended]
        digit = padded[(off[rows] + at)[:, None] + np.arange(8)]
        digit[(at + np.arange(8))[None, :] >= size[rows][:, None]] = 0
        digit = digit.copy().view("<u8").ravel()
        at += 8
        order = np.lexsort((digit, label))
        rows, label, digit = rows[order], label[order], digit[order]
        group = np.cumsum(np.r_[True, (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])][: len(rows)])
    return rep


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: blocks of rows to their representatives and members."""
    base, count = TaskContext.get().partitionId() << 33, 0
    for part in common.blocks(batches):
        t = pa.Table.from_batches(part).combine_chunks()
        body, doc = t["body"].chunk(0), t["doc_id"].chunk(0)
        data, off = common.column_bytes(body)
        rep = radix_classes(data, off)
        n = len(rep)
        rid = base + count + np.arange(n)
        count += n
        low, keep, total = _merged(rep, doc.fill_null(NONE).to_numpy(), rid, np.ones(n, np.int64))
        own = pa.array(rep == np.arange(n))
        own_body = body.take(pa.array(np.arange(n), mask=rep != np.arange(n)))
        only = lambda v, own=own: pc.if_else(own, v, pa.scalar(None, v.type))
        yield pa.record_batch(
            [doc, pa.array(rid), pa.array(rid[rep]), t["text_sha256"].chunk(0), only(pa.array(total)), only(pa.array(low)), only(pa.array(keep)), only(pa.array(np.diff(off))), pc.binary_slice(own_body, 0, WIDTHS[0]), own_body],
            names=[f.split()[0] for f in LOCAL.split(", ")],
        )


def _merged(rep: np.ndarray, doc: np.ndarray, rid: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row, of its class: the smallest doc_id, the row that has it, the number of rows."""
    low, keep, total = np.full(len(rep), NONE), np.full(len(rep), NONE), np.zeros(len(rep), np.int64)
    np.minimum.at(low, rep, doc)
    best = doc == low[rep]
    np.minimum.at(keep, rep[best], rid[best])
    np.add.at(total, rep, count)
    return low[rep], keep[rep], total[rep]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, in a task: whole digit groups to classes."""
    for part in common.blocks(batches, "digit"):
        t = pa.Table.from_batches(part).combine_chunks()
        rep = radix_classes(*common.column_bytes(t["body"].chunk(0)))
        low, keep, total = _merged(rep, t["min_doc"].to_numpy(), t["keep_rid"].to_numpy(), t["n_local"].to_numpy())
        yield pa.record_batch([t["rid"].chunk(0), pa.array(low), pa.array(keep), pa.array(total)], names=[f.split()[0] for f in CLASSES.split(", ")])


def classes_of(reps: DataFrame, tmp: common.Scratch, max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """Of representatives (rid, min_doc, keep_rid, n_local, len, lead, body) their classes, by the distributed recursion."""
    out, pending = [], reps
    for width in WIDTHS:
        lead = F.col("lead") if width == WIDTHS[0] else F.expr(f"substring(body, 1, {width})")
        rows = pending.withColumn("digit", F.xxhash64("len", lead))
        full = rows.groupBy("digit").agg(F.sum(F.col("len") + 64).alias("bytes")).where(F.col("bytes") > max_group_bytes).select("digit")
        full = tmp.written(full, "digits")
        split = not full.isEmpty()
        fits = rows.join(F.broadcast(full), "digit", "left_anti") if split else rows
        dealt = fits.repartition("digit").sortWithinPartitions("digit")
        out.append(dealt.select("rid", "min_doc", "keep_rid", "n_local", "digit", "body").mapInArrow(_finish, CLASSES))
        if not split:
            break
        pending = tmp.written(rows.join(F.broadcast(full), "digit", "left_semi").select(*reps.columns), "unsplit")
    else:  # the rest by their whole bytes: each group has ended, so it is a class, and partial sums do
        best = F.min(F.struct("min_doc", "keep_rid")).alias("k")
        whole = pending.withColumn("digit", F.xxhash64("body"))  # only deals rows into parts; bodies decide
        total = tmp.written(whole.groupBy("digit", "body").agg(best, F.sum("n_local").alias("total")), "ended")
        ended = common.hot_join(whole.select("rid", "digit", "body"), total, ["digit", "body"], "rid", by=["digit"])
        out.append(ended.select(F.col("rid").alias("rep"), F.col("k.min_doc").alias("keep_id"), F.col("k.keep_rid").alias("keep_rid"), F.col("total").alias("group_size")))
    return functools.reduce(DataFrame.unionByName, out)


def exact_duplicates(docs: DataFrame, max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256. All tables of a run but its result are deleted at its end."""
    body = normalised()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(body, 256).alias("text_sha256"), body.cast("binary").alias("body"))
    with common.Scratch(docs.sparkSession) as tmp:
        local = tmp.written(rows.mapInArrow(_local, LOCAL), "local")
        reps = local.where("n_local is not null").select("rid", "min_doc", "keep_rid", "n_local", "len", "lead", "body")
        classes = classes_of(reps, tmp, max_group_bytes)
        joined = local.select("doc_id", "rid", "rep", "text_sha256").join(classes, "rep")
        out = joined.select("doc_id", F.nullif("keep_id", F.lit(NONE)).alias("keep_id"), "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256")
        return common.written(out, "classes")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: exact duplicates over all documents."""
    return exact_duplicates(common.read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (body)
"""
