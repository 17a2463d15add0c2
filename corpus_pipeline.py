"""From raw documents to a training mix: each stage calls one operator on what its
predecessor kept. Shared text moves as Parquet between the stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.llm.common import cols, keep_for_run, shared_folder, table
from quaylark.llm.decontaminate import remove_contaminated
from quaylark.llm.linededup import drop_boilerplate
from quaylark.llm.mixing import mixed_documents
from quaylark.llm.neardup import keep_first
from quaylark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    out = drop_boilerplate(docs)
    if "n_chars" in docs.columns:  # it is the length of what is left
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*cols(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8."""
    return keep_first(docs, k=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the number of copies of each."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
]

#: SQL can't express compression distances, registers or hash order.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each stage's table stays in the shared folder, for the
    next one and for lost executors, until the driver ends. Nulls, empty texts, repeated
    rows, empty tables and further columns are as each operator states; rows may repeat."""
    docs = table(spark, sf_dir, "documents")
    folder = keep_for_run(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
