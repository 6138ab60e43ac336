"""Spot checks on intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def both_treated(baseline: DataFrame) -> DataFrame:
    """Persons with both treatment kinds on the entry day."""
    return baseline.where(F.col("first_txt") == "both")


def outcome_counts(pregnancies: DataFrame) -> DataFrame:
    """Outcome events per person and kind."""
    return pregnancies.groupBy("person_id", "concept_set").agg(F.count("*").alias("n"))


def person_rows(df: DataFrame, person_id: int) -> DataFrame:
    """All rows of one person."""
    return df.where(F.col("person_id") == F.lit(person_id).cast("long"))


def mixed_first_cycle(treatment_rows: DataFrame, freq: str | None = None) -> DataFrame:
    """Rows per treatment kind of persons with more than one kind in the first cycle.

    Takes rows with their cycle number; ``freq`` names a count column of already
    grouped rows. The window sees one row per person and kind.
    """
    n = F.sum(freq) if freq else F.count("*")
    counts = treatment_rows.where("cycle = 1").groupBy("person_id", "concept_set").agg(n.alias("n"))
    kinds = F.count("*").over(W.partitionBy("person_id"))
    return counts.withColumn("kinds", kinds).where("kinds > 1").drop("kinds")
