"""Study inputs derived from the order tables: orders are patients' claims, parts are concepts.

Each function is lazy. ``clinical_events`` joins on the order key before the
concept key is used and states that its columns are known, so that every branch
of a query starts with the same scans and shuffles and Spark runs them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import TREATMENT_SETS

# Highest p_size of each concept set.
SET_BY_MAX_SIZE = (
    (12, "IUI"),
    (20, "ART"),
    (26, "pregnant"),
    (30, "labor"),
    (32, "abortion"),
    (33, "stillbirth"),
    (36, "tobacco"),
    (39, "alcohol"),
    (42, "obesity"),
    (44, "PCOS"),
    (48, "f_infert"),
    (50, "m_infert"),
)
EVENT_TABLES = ("lineitem", "orders")
ANCESTOR_OFFSET = 1_000_000_000_000
COHORT_FROM = "1996-01-01"
COHORT_DEFINITION_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_of_size(size: Column) -> Column:
    branches = F.when(size <= SET_BY_MAX_SIZE[0][0], SET_BY_MAX_SIZE[0][1])
    for limit, name in SET_BY_MAX_SIZE[1:]:
        branches = branches.when(size <= limit, name)
    return branches


def clinical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, date, concept_id: one row per line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    events = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_partkey").alias("concept_id"),
    )
    return events.where("person_id is not null and date is not null and concept_id is not null")


def concept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """concept_set, concept_id: resolved membership of the twelve sets."""
    return table(spark, sf_dir, "part").select(
        set_of_size(F.col("p_size")).alias("concept_set"),
        F.col("p_partkey").alias("concept_id"),
    ).where("concept_set is not null")


def concept_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ancestor_concept_id, descendant_concept_id; every part's ancestor is its size."""
    return table(spark, sf_dir, "part").select(
        (F.col("p_size").cast("long") + F.lit(ANCESTOR_OFFSET)).alias("ancestor_concept_id"),
        F.col("p_partkey").alias("descendant_concept_id"),
    )


def concept_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent_concept_id, child_concept_id: direct links only. A part's parent is its size, a size's parent is half of it."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"))
    of_parts = part.select((F.col("size") + ANCESTOR_OFFSET).alias("parent_concept_id"), F.col("p_partkey").alias("child_concept_id"))
    sizes = part.select("size").distinct().where("size > 1")
    of_sizes = sizes.select(
        (F.floor(F.col("size") / 2) + ANCESTOR_OFFSET).alias("parent_concept_id"), (F.col("size") + ANCESTOR_OFFSET).alias("child_concept_id")
    )
    return of_parts.unionByName(of_sizes)


def concept_set_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set definitions: each size with its descendants, less the lowest part of the set.

    The last size of each set is listed again as excluded with descendants.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sizes = part.select("p_size").distinct().withColumn("concept_set", set_of_size(F.col("p_size")))
    ancestor = (F.col("p_size").cast("long") + F.lit(ANCESTOR_OFFSET)).alias("concept_id")
    included = sizes.select("concept_set", ancestor, F.lit(True).alias("include_descendants"), F.lit(False).alias("is_excluded"))
    last_sizes = [limit for limit, name in SET_BY_MAX_SIZE if name != "stillbirth"]
    excluded_sizes = sizes.where(F.col("p_size").isin(last_sizes)).select(
        "concept_set", ancestor, F.lit(True).alias("include_descendants"), F.lit(True).alias("is_excluded")
    )
    excluded_parts = (
        part.groupBy(set_of_size(F.col("p_size")).alias("concept_set"))
        .agg(F.min("p_partkey").alias("concept_id"))
        .select("concept_set", "concept_id", F.lit(False).alias("include_descendants"), F.lit(True).alias("is_excluded"))
    )
    return included.unionByName(excluded_sizes).unionByName(excluded_parts)


def observation_period(coded_events: DataFrame) -> DataFrame:
    """First and last event date of each person."""
    return coded_events.groupBy("person_id").agg(
        F.min("date").alias("observation_period_start_date"),
        F.max("date").alias("observation_period_end_date"),
    )


def cohort(coded_events: DataFrame) -> DataFrame:
    """One entry per person: first treatment from COHORT_FROM on, follow-up of 200 to 800 days.

    One aggregate with map-side combine; no join back to the events.
    """
    entry = F.col("concept_set").isin(*TREATMENT_SETS) & (F.col("date") >= F.lit(COHORT_FROM).cast("date"))
    follow_up = (F.lit(200) + (F.col("subject_id") % 5) * 150).cast("int")
    return (
        coded_events.groupBy(F.col("person_id").alias("subject_id"))
        .agg(
            F.min(F.when(entry, F.col("date"))).alias("cohort_start_date"),
            F.max("date").alias("observation_end"),
        )
        .where(F.col("cohort_start_date").isNotNull())
        .select(
            F.lit(COHORT_DEFINITION_ID).alias("cohort_definition_id"),
            "subject_id",
            "cohort_start_date",
            F.least("observation_end", F.date_add("cohort_start_date", follow_up)).alias("cohort_end_date"),
        )
    )
