"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.llm import clusters, decontaminate, divergence, linededup, neardup, ngramjoin
from quaylark.llm.clusters import cluster_report
from quaylark.llm.common import table
from quaylark.llm.decontaminate import contamination_report
from quaylark.llm.divergence import divergence_report
from quaylark.llm.linededup import line_report
from quaylark.llm.mixing import mix_report
from quaylark.llm.neardup import near_duplicates
from quaylark.llm.ngramjoin import ngram_join
from quaylark.llm.pages import extract_main_text
from quaylark.llm.pii import pii_report
from quaylark.llm.secrets import secret_report
from quaylark.llm.simhash import fingerprint_report
from quaylark.llm.tokens import token_counts
from quaylark.llm.toxicity import toxicity_report


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return n.withColumn("over_limit", F.col("n_tokens") > 4096)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A ledger that outlives the run may be named in the session.
    return secret_report(table(spark, sf_dir, "documents"), spark.conf.get("quaylark.secrets.ledger", None))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_report(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"), k=4, threshold=0.85)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_secret_scan": op6_secret_scan,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_html_text": op10_html_text,
    "op11_divergence": op11_divergence,
    "op12_clusters": op12_clusters,
    "op13_ngram_join": op13_ngram_join,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op4_decontaminate": decontaminate.ORACLE, "op7_near_duplicates": neardup.ORACLE, "op8_line_dedup": linededup.ORACLE, "op11_divergence": divergence.ORACLE, "op12_clusters": clusters.ORACLE, "op13_ngram_join": ngramjoin.ORACLE}
