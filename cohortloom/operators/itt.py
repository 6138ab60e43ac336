"""One intention-to-treat row per person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CENSORED, LIVE_BIRTH, PREGNANCY, StudyConfig
from ..functions.columns import if_else, least_or_null


def first_treatment_label() -> Column:
    """Kind of treatment on the entry day; no treatment recorded that day counts as IUI."""
    return (
        F.when(F.col("concept_id_ART").isNull(), "IUI")
        .when(F.col("concept_id_IUI").isNull(), "ART")
        .otherwise("both")
    )


def rollup_aggregates() -> list[Column]:
    """Per-person aggregates over cycle rows."""
    outcome = F.col("outcome")
    return [
        F.bool_or(outcome.isin(PREGNANCY, LIVE_BIRTH)).cast("double").alias("any_pregnancy"),
        F.bool_or(outcome == LIVE_BIRTH).cast("double").alias("any_live_birth"),
        F.min("labor").alias("delivery_date"),
        F.min("pregnant").alias("pregnancy_date"),
        F.max("day_1").alias("last_cycle"),
        F.bool_and(outcome == CENSORED).cast("double").alias("censored"),
    ]


def itt_rollup(cycle_outcomes: DataFrame) -> DataFrame:
    return cycle_outcomes.groupBy("person_id").agg(*rollup_aggregates())


def itt_columns(rolled: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Event flags, dates cut at the horizon, times in days and the arm.

    An event at or after the horizon keeps its flag while its time is cut;
    ``late_events="censor"`` clears the flag instead.
    """
    horizon = F.date_add("cohort_start_date", config.horizon_days)
    last_day = least_or_null(F.col("cohort_end_date"), horizon)
    arm = F.when(F.col("first_txt") == "IUI", "IUI").when(F.col("first_txt").isNotNull(), "ART")

    def event(date: str) -> Column:
        known = F.col(date).isNotNull()
        return known if config.late_events == "keep" else F.coalesce(F.col(date) < horizon, F.lit(False))

    def cut(date: str) -> Column:
        return if_else(F.col(date).isNotNull() & (F.col(date) < horizon), F.col(date), last_day)

    def days_to(date: str) -> Column:
        return F.datediff(F.col(date), F.col("cohort_start_date")).cast("double")

    flagged = rolled.withColumns(
        {"event_pregnancy": event("pregnancy_date"), "event_delivery": event("delivery_date")}
    ).withColumns({"pregnancy_date": cut("pregnancy_date"), "delivery_date": cut("delivery_date")})
    return flagged.withColumns(
        {
            "time_to_pregnancy": days_to("pregnancy_date"),
            "time_to_delivery": days_to("delivery_date"),
            "IUI": arm,
        }
    )


def itt(rollup: DataFrame, baseline: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """ITT rows from separate tables; the full join keeps persons without a cycle."""
    return itt_columns(rollup.join(baseline, "person_id", "full"), config)


def itt_analysis(itt_rows: DataFrame) -> DataFrame:
    """Drop persons with an event on or before their entry day."""
    pregnancy_ok = ~F.col("event_pregnancy") | (F.col("time_to_pregnancy") > 0)
    delivery_ok = ~F.col("event_delivery") | (F.col("time_to_delivery") > 0)
    return itt_rows.where(pregnancy_ok & delivery_ok)
