"""What the corpus operators share: written tables and hot joins (of sources.shared) and byte-level text helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import VECTORED, Scratch, checked, delete, hot_join, hot_keys, numbered, only, shared_dir, spread, table_path, written  # noqa: F401

#: One or more ASCII white-space characters, as Java and RE2 both read it.
ASCII_SPACE = r"[\x20\x09-\x0D]+"

#: Python steps that need a block of rows together take about so many bytes of text.
BLOCK_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow string or binary array without nulls: its bytes and the n + 1 offsets into them."""
    wide = str(col.type).startswith("large")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], key: str | None = None, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """Consecutive rows of about limit bytes of body; with a key (equal values of it adjoin), none of its runs is cut."""
    held, size, last = [], 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        off = column_bytes(batch.column("body"))[1] + 64 * np.arange(n + 1)
        edges = np.arange(n)
        if key:
            v = batch.column(key).to_numpy()
            edges = np.flatnonzero(np.r_[last is None or v[0] != last, v[1:] != v[:-1]])
            last = v[-1]
        start = 0
        while True:
            full = max(int(np.searchsorted(off, off[start] + limit - size)), start + (not held))
            at = int(np.searchsorted(edges, full))
            if at == len(edges):
                break
            if edges[at] > start:
                held.append(batch.slice(start, edges[at] - start))
            yield held
            held, size, start = [], 0, int(edges[at])
        held.append(batch.slice(start))
        size += int(off[n] - off[start])
    if held:
        yield held
