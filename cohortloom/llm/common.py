"""Shared small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import tune

# White space between words: space and the characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"

# One Arrow batch holds at most this much, so a worker's memory depends on its longest text only.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


_shipped: set[str] = set()  # applications whose workers have the package


def ship_package(spark: SparkSession) -> None:
    """Give the package's code to all Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package, folder = Path(__file__).resolve().parents[1], tempfile.mkdtemp(prefix="code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the archive until the program ends
        shutil.copytree(package, f"{folder}/code/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/code"))
        _shipped.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """The session settings and the code the operators rely on."""
    ship_package(spark)
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return tune(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(text: str = "text") -> Column:
    """The text's UTF-8 bytes; a null text is an empty one."""
    return F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))


def tokenizer_file(path: str | None = None) -> str:
    """Content of a tokenizer file, by default the public one; the driver reads it and sends it to the tasks."""
    return Path(path or public_tokenizers.path(TOKENIZER)).read_text(encoding="utf-8")


def model_file(path: str | None = None) -> bytes:
    """Content of a sentencepiece model, by default the public one; the driver reads it and sends it to the tasks."""
    return Path(path or public_tokenizers.path(PIECE_MODEL)).read_bytes()
