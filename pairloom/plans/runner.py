"""A linkage run as named stages, each a table that is built once and read by those after it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import io

Build = Callable[[dict[str, DataFrame]], DataFrame]


def run_stages(spark: SparkSession, folder: str, stages: dict[str, Build], wanted: str = "all", progress: Callable[[str], None] | None = None) -> dict[str, DataFrame]:
    """The tables of all stages up to `wanted`, by name and in order, under folder/<name>.

    A stage is built from the tables before it, unless an earlier run finished writing it: a run that was stopped goes on
    where it ended. progress is told the name of each stage that is built. An unknown stage raises KeyError.
    """
    if wanted != "all" and wanted not in stages:
        raise KeyError(wanted)
    done: dict[str, DataFrame] = {}
    for name, build in stages.items():

        def made(name: str = name, build: Build = build) -> DataFrame:
            if progress:
                progress(name)
            return build(dict(done))

        done[name] = io.stage(spark, f"{folder}/{name}", made)
        if name == wanted:
            break
    return done
