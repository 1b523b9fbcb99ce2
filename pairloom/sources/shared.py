"""The shared folder and the tables that are written there; joins on keys that may hold any share of all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A setting of the Parquet reader. With vectored reads an executor took about 1 GB more for a column chunk of 0.6 GB.
VECTORED = "parquet.hadoop.vectored.io.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session that has neither gets one of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark)}/pairloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and the files outlive executors."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The written tables of one run. Those that its result does not read are deleted when the run ends, however it ends.

        with Scratch(spark) as tmp:
            a = tmp.written(df, "a")
            return common.written(f(a), "result")
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*self.paths)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = table_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, which nothing will read any more."""
        for name in list(names):
            for path in self.paths.pop(name, []):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark writes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, name: str = "__pairloom_rid") -> DataFrame:
    """df, written, with a number of each row that stays the same however often the table is read."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


@contextmanager
def plain_reads(spark: SparkSession) -> Iterator[None]:
    """Inside, the session's Parquet scans do without vectored reads."""
    before = spark.conf.get(VECTORED, None)
    spark.conf.set(VECTORED, "false")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(VECTORED)
        else:
            spark.conf.set(VECTORED, before)


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read. Where a few of the scan's tasks hold its rows, it is written anew with the rows dealt to all of them.

    A row group is read by one task, so a file of one large row group is read by one, however many splits it has. Rows of
    tasks are counted without any column, from the files' footers.
    """
    spark = table.sparkSession
    tasks = table.rdd.getNumPartitions()
    counts = table.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    if not total or most <= max(2 * total / tasks, total / spark.sparkContext.defaultParallelism):
        return table
    with plain_reads(spark):
        return written(table.withColumn("__pairloom_row", F.monotonically_increasing_id()).repartition(tasks, "__pairloom_row").drop("__pairloom_row"), "spread")


def hot_keys(counts: DataFrame, by: list[str], total: int, share: int = 4) -> DataFrame | None:
    """Of counts (by, __n) the keys with more than 1 / (share * tasks) of total rows: by, __parts, how many parts to deal them into; None without any.

    There are at most share * tasks of them, whatever the data: that bound is what lets them pass through the driver and be broadcast.
    """
    spark = counts.sparkSession
    most = max(1, total // (share * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    hot = counts.where(F.col("__n") > most).select(*by, F.ceil(F.col("__n") / most).cast("int").alias("__parts"))
    rows = hot.collect()
    return spark.createDataFrame(rows, hot.schema) if rows else None


def hot_join(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", by: list[str] | None = None, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """big joined with small on `on`, where one key of big may hold any share of its rows and small has few rows of each key.

    Rows of hot keys (by `by`, a subset of `on`) are dealt into parts by a hash of the column spread, and small's rows of
    those keys are repeated for each part, so no task gets more than its share. counts (by, __n) and total say how often keys
    stand in big; without them big is read once more, so it should be a written table.
    """
    by = by or on
    counts = big.groupBy(*by).agg(F.count("*").alias("__n")) if counts is None else counts
    hot = hot_keys(counts, by, big.count() if total is None else total)
    if hot is None:
        return big.join(small, on, how)
    parts = F.coalesce("__parts", F.lit(1))
    left = big.join(F.broadcast(hot), by, "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    right = small.join(F.broadcast(hot), by, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*on, "__part"], how).drop("__part")


def checked(table: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table, to be broadcast if it is counted to have at most `most` rows."""
    return F.broadcast(table) if table.count() <= most else table


def only(rows: DataFrame, ids: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """rows whose key is in ids (one written column of it): filtered before any shuffle if ids are counted to be at most `most`, else all rows, as a join will drop them."""
    return rows.join(F.broadcast(ids), key, "left_semi") if ids.count() <= most else rows
