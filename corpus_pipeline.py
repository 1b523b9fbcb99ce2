"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token output.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Rows with null columns, repeated rows and empty tables pass as the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import common, decontam, minhash, mixing, quality, token_output


def _quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The model of the labelled rows of documents that are not held out; every call fits the same."""
    labels = common.read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = spark.read.option(common.VECTORED, "false").parquet(f"{sf_dir}/documents.parquet")
    return quality.train(docs, labels.where(~quality.held_out()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; the first stage, so rows of large row groups are dealt out here."""
    docs = common.spread(docs)
    return quality.score(docs, _quality_model(spark, sf_dir), name="__pairloom_score").where(f"__pairloom_score >= {quality.THRESHOLD}").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more)."""
    return minhash.one_of_each(docs, words=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, common.read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; the classifier's score is a document's weight."""
    scored = common.written(quality.score(docs, _quality_model(spark, sf_dir), name="__pairloom_weight"), "scored")
    return mixing.mix(scored, weight=F.greatest("__pairloom_weight", F.lit(1e-6))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = common.table_path(spark, "tokens")
    token_output.write_tokens(docs, path, public_tokenizers.path(token_output.TOKENIZER))
    return token_output.read_tokens(spark, path)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]
#: No SQL expresses the trained classifier, the components or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage wrote is deleted once the last has read it."""
    docs = common.read_table(spark, sf_dir, "documents")
    with common.Scratch(spark) as tmp:
        for name, stage in STAGES[:-1]:
            docs = tmp.written(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
