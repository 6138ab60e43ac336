"""A training-data pipeline over ``documents``: filter, deduplicate, redact, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import bpe, mixing, quality, secret_scan, simhash
from cohortloom.llm.common import prepare, read, tokenizer_file
from cohortloom.session import materialize, use_local_folder

# Fingerprints, redaction and random rounding are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    prepare(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash of three-word shingles, at most two bits apart) one document stays."""
    prepare(spark)
    return simhash.keep_one(docs, ngram=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are covered."""
    prepare(spark)
    return secret_scan.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as many times as the mix takes it, perhaps never."""
    prepare(spark)
    return mixing.take_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the text they decode to, for each row."""
    prepare(spark)
    return bpe.encode_decode(docs, tokenizer_file())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secrets", secrets),
    ("source mix", source_mix),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = read(use_local_folder(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
