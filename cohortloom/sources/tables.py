"""Reading and writing study tables through the catalog or as parquet folders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..config import StudyConfig
from ..operators.cohort import CohortSpec
from ..session import materialize

DEFINITION = "cohort_definition_id"
MANIFEST = "cohort_manifest"
COHORT_TABLES = {
    "cohort": schemas.COHORT,
    "cohort_attrition": schemas.COHORT_ATTRITION,
    "cohort_censoring": schemas.COHORT_CENSORING,
    "cohort_inclusion": schemas.COHORT_INCLUSION,
    "cohort_rule_gain": schemas.COHORT_RULE_GAIN,
    "cohort_summary": schemas.COHORT_SUMMARY,
}


def scan_table(spark: SparkSession, table: str, schema: str | None = None) -> DataFrame:
    """Lazy scan of ``schema.table``."""
    return spark.table(f"{schema}.{table}" if schema else table)


def source_table(spark: SparkSession, table: str, config: StudyConfig = StudyConfig()) -> DataFrame:
    """A clinical table in the study's source schema."""
    return scan_table(spark, table, config.source_schema)


def study_table(spark: SparkSession, table: str, config: StudyConfig = StudyConfig()) -> DataFrame:
    """A table the study has written, such as its cohort."""
    return scan_table(spark, table, config.write_schema)


def empty_table(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def create_cohort_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Write the empty cohort and statistics tables; returns their paths."""
    paths = {}
    for name, schema in COHORT_TABLES.items():
        paths[name] = f"{folder}/{name}"
        empty_table(spark, schema).write.mode("overwrite").parquet(paths[name])
    return paths


def _replace(rows: DataFrame, path: str) -> None:
    """Store rows by definition. Only the folders of definitions among the rows are replaced, and only once all rows are written."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DEFINITION).parquet(path)


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _drop_definitions(spark: SparkSession, path: str, ids: Iterable[int]) -> None:
    for number in ids:
        system, folder = _hadoop_path(spark, f"{path}/{DEFINITION}={number}")
        system.delete(folder, True)


def write_cohort(cohort: DataFrame, path: str) -> None:
    """Store generated cohorts, one folder per definition; stored definitions that have no rows in ``cohort`` stay.

    One task per definition would be a bottleneck, so rows stay where they are:
    every task writes its part of each definition it holds.
    """
    _replace(cohort, path)


def read_cohort(spark: SparkSession, path: str, cohort_definition_id: int | None = None) -> DataFrame:
    """Scan a stored cohort; a definition id prunes to that definition's folder."""
    cohort = spark.read.schema(schemas.COHORT).parquet(path)
    if cohort_definition_id is not None:
        cohort = cohort.where(cohort.cohort_definition_id == cohort_definition_id)
    return cohort.select(*schemas.COHORT.fieldNames())


def write_cohort_results(results: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Store generated cohorts and their statistics (see ``cohort.cohort_results``); returns the paths. Other definitions stay."""
    paths = {name: f"{folder}/{name}" for name in results}
    for name, frame in results.items():
        _replace(frame, paths[name])
    return paths


def read_cohort_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored cohort and statistics tables by name."""
    return {
        name: spark.read.schema(schema).parquet(f"{folder}/{name}").select(*schema.fieldNames())
        for name, schema in COHORT_TABLES.items()
    }


def definition_checksum(spec: CohortSpec, source: str = "") -> str:
    """Changes with anything in a definition, and with ``source``, the caller's name for the state of the event data."""
    return hashlib.sha256(repr((spec, source)).encode()).hexdigest()


def read_manifest(spark: SparkSession, folder: str) -> dict[int, Row]:
    """The manifest's row of every stored definition; it has one row per definition."""
    system, path = _hadoop_path(spark, f"{folder}/{MANIFEST}")
    if not system.exists(path):
        return {}
    rows = spark.read.schema(schemas.COHORT_MANIFEST).parquet(f"{folder}/{MANIFEST}").collect()
    return {row[DEFINITION]: row for row in rows}


def store_definitions(
    spark: SparkSession, folder: str, specs: Sequence[CohortSpec], generate: Callable[[Sequence[CohortSpec]], dict[str, DataFrame]], source: str = ""
) -> list[int]:
    """Bring a store of cohorts up to date; returns the ids that were generated anew.

    A definition whose checksum the manifest already holds is left alone. ``generate`` makes
    the tables of the others (see ``cohort.cohort_results``) in one go. Their folders are
    replaced table by table, other definitions' folders are not touched, and the
    manifest is written last: after a write that broke, old rows or new ones stand
    in every folder, the manifest still holds the old checksum, and the next call
    generates the definition again. A definition that has lost all its rows loses its folder.
    """
    known = read_manifest(spark, folder)
    wanted = {spec.cohort_definition_id: definition_checksum(spec, source) for spec in specs}
    if len(wanted) < len(specs):
        raise ValueError("two definitions have one id")
    changed = [spec for spec in specs if (row := known.get(spec.cohort_definition_id)) is None or row.checksum != wanted[spec.cohort_definition_id]]
    if not changed:
        return []
    ids = [spec.cohort_definition_id for spec in changed]
    # all tables are complete before the first folder is touched
    made = {name: materialize(frame, name.replace("_", "-")) for name, frame in generate(changed).items()}
    for name, frame in made.items():
        present = {row[DEFINITION] for row in frame.select(DEFINITION).distinct().collect()}
        _replace(frame, f"{folder}/{name}")
        _drop_definitions(spark, f"{folder}/{name}", set(ids) - present)
    stored = made["cohort"]
    hashes = F.xxhash64("subject_id", "cohort_start_date", "cohort_end_date")
    sums = stored.groupBy(DEFINITION).agg(F.count("*").alias("row_count"), F.bit_xor(hashes).alias("row_hash"))
    listed = spark.createDataFrame(list(wanted.items()), f"{DEFINITION} int, checksum string").where(F.col(DEFINITION).isin(ids))
    manifest = listed.join(sums, DEFINITION, "left").fillna(0, ["row_count", "row_hash"])
    _replace(manifest.coalesce(1), f"{folder}/{MANIFEST}")
    return ids


def write_events(events: DataFrame, path: str) -> None:
    """Store events by month. Rebalanced by month first, so that a month's files are few and a large month is several tasks."""
    monthly = events.withColumn("month", F.trunc("date", "month"))
    monthly.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored events with their ``month``; a filter on it skips folders."""
    return spark.read.schema(schemas.STORED_EVENTS).parquet(path)
