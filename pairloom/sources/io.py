"""Scans and sinks: quote-free TSV, ground truth, tagged unions, and list files."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("entity_id", "business_name", "business_address", "country")


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def scan_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """Tab-separated text with a header and no quoting; all columns are strings."""
    return spark.read.options(sep="\t", quote="", header=True, escape="").schema(strings(*columns)).csv(path)


def load_source(spark: SparkSession, path: str) -> DataFrame:
    """Records with nulls as empty strings."""
    return scan_tsv(spark, path).fillna("", list(RECORD))


def load_truth(wide: DataFrame, key: str = "source1_entity_id", lists: str = "matched_entity_ids") -> DataFrame:
    """Wide truth (key, comma list) to s1, match; an s1 without matches keeps one null row."""
    parts = F.filter(F.split(F.coalesce(F.col(lists), F.lit("")), ","), lambda x: F.trim(x) != "")
    return wide.select(F.col(key).alias("s1"), F.explode_outer(parts).alias("match")).withColumn("match", F.trim("match"))


def scan_records(spark: SparkSession, path: str, columns: list[str], country: str | None = None, by: str = "country") -> DataFrame:
    """A Parquet scan with column pruning and a pushed filter on country (or another column)."""
    df = spark.read.parquet(path)
    return (df if country is None else df.where(F.col(by) == country)).select(*columns)


def union_sources(parts: dict[int, DataFrame]) -> DataFrame:
    """Tables as one pool with the tag src."""
    out = None
    for src, df in parts.items():
        one = df.withColumn("src", F.lit(src).cast("tinyint"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def records_text(df: DataFrame) -> DataFrame:
    """id and one text for model input."""
    return df.select("id", F.concat_ws(" | ", "name", "addr", "state").alias("text"))


def write_lists(lists: DataFrame, path: str, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> None:
    """Two columns as TSV without quotes; empty lists stay empty."""
    lists.toDF(*header).write.options(sep="\t", quote="", header=True, emptyValue="").csv(path)


def read_lists(spark: SparkSession, path: str, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> DataFrame:
    """A list file as s1, matched (sorted distinct ids); an s1 that occurs twice raises."""
    df = scan_tsv(spark, path, header).toDF("s1", "m")
    df = df.select("s1", F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce("m", F.lit("")), ","), lambda x: x != ""))).alias("matched"))
    twice = df.groupBy("s1").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].s1} occurs more than once")
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unchanged(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """file_digests of a path, which must equal a manifest (path, length, sha256) of an earlier run; any difference raises ValueError."""
    now = file_digests(spark, path)
    columns = ["path", "length", "sha256"]
    odd = now.select(*columns).exceptAll(manifest.select(*columns)).union(manifest.select(*columns).exceptAll(now.select(*columns))).select("path").first()
    if odd:
        raise ValueError(f"{odd.path} is not what it was")
    return now


def validated_join(left: DataFrame, right: DataFrame, on: list[str], kind: str = "m:1", how: str = "inner") -> DataFrame:
    """A join whose key must be unique on the right (m:1), or on both sides (1:1)."""
    for side, df in (("right", right), ("left", left)):
        if side == "left" and kind != "1:1":
            continue
        if not df.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"the {side} side has repeated keys")
    return left.join(right, on, how)


def scan_zip_tsv(spark: SparkSession, path: str, member: str, columns: tuple[str, ...] = RECORD, batch: int = 10_000) -> DataFrame:
    """The TSV member of each zip archive at path, tab-separated without quoting, its first line a header; missing fields are
    null. An archive is one task, read in batches of lines; repartition the result where archives are few and large."""

    def lines(tables):
        for t in tables:
            for content in t.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z, z.open(member) as f:
                    text = io.TextIOWrapper(f, "utf-8", newline="\n")
                    header = next(text, "").rstrip("\r\n").split("\t")
                    at = [header.index(c) if c in header else None for c in columns]
                    while rows := [line.rstrip("\r\n").split("\t") for line in itertools.islice(text, batch)]:
                        yield pa.RecordBatch.from_pydict({c: pa.array([r[k] if k is not None and k < len(r) else None for r in rows], pa.string()) for c, k in zip(columns, at)})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, strings(*columns))


def truth_sets(long: DataFrame) -> DataFrame:
    """s1, matches: the sorted set of matches of each s1 of a long ground truth, empty for singletons."""
    return long.groupBy("s1").agg(F.array_sort(F.collect_set("match")).alias("matches"))


def restricted(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is among the only column of ids; a semi join, so repeated and null ids do no harm."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi").select(*df.columns)


def split_by_ids(pairs: DataFrame, subsets: dict[str, DataFrame], column: str = "s1") -> dict[str, DataFrame]:
    """pairs restricted to each subset of ids."""
    return {name: restricted(pairs, ids, column) for name, ids in subsets.items()}


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written first unless an earlier run finished writing it (its commit marker is there)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
