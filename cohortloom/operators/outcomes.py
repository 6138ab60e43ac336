"""Attributing pregnancy outcomes to treatment cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CENSORED, LIVE_BIRTH, NO_PREGNANCY, PREGNANCY, PREGNANCY_LOSS, StudyConfig
from . import scan

MAX_DAY = 2**31 - 1  # stands for an unknown date
CYCLE_COLUMNS = ("person_id", "concept_set", "day_1", "cycle", "next_cycle", "end_preg")


def pregnancies(outcome_events: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """All outcome events by date, unknown dates last.

    The sort runs on a full key: a date with very many events is then split
    over several range partitions instead of landing in one.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in config.outcome_sets]), F.col("concept_set"))
    return outcome_events.orderBy(F.col("date").asc_nulls_last(), order, "person_id", "concept_id")


def numbered_pregnancies(outcome_events: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Outcome events with their ``position`` in the order of ``pregnancies``, from 1; unknown dates come last.

    Equal rows are counted first, so a day or person with very many of them is a few rows;
    the counts are summed up over ranges of the order and the rows put back.
    """
    kind = F.array_position(F.array(*[F.lit(s) for s in config.outcome_sets]), F.col("concept_set"))
    day = F.coalesce(F.datediff("date", F.lit("1970-01-01").cast("date")), F.lit(MAX_DAY))
    names = ["person_id", "date", "concept_id", "concept_set"]
    place = F.struct(day.alias("day"), kind.alias("kind"), "person_id", "concept_id")
    counted = outcome_events.groupBy(*names).agg(F.count("*").alias("n")).withColumns({"place": place, "order": F.lit("outcomes")})
    stored = scan.ranged(counted, "place", label="outcome-order")
    summed = scan.running_sums(stored, ["order"], "place", {"up_to": F.col("n")})
    last = F.col("up_to").cast("long")
    return summed.select(*names, F.explode(F.sequence(last - F.col("n") + 1, last)).alias("position"))


def outcome_days(outcome_events: DataFrame) -> DataFrame:
    """Distinct outcome days per person and kind."""
    return outcome_events.select("person_id", "date", F.col("concept_set").alias("preg_concept")).distinct()


def _in_follow_up() -> Column:
    """Join condition between cycles aliased "c" and outcomes aliased "o"."""
    same_person = F.col("c.person_id") == F.col("o.person_id")
    return same_person & F.col("o.date").between(F.col("c.day_1"), F.col("c.end_preg"))


def range_join_days(cycles: DataFrame, days: DataFrame) -> DataFrame:
    """Cycles left-joined to the outcome days inside their follow-up (both ends included).

    An outcome on the next cycle's first day belongs to both cycles. ``days``
    must be distinct days: at most (days x kinds) rows meet in one person.
    """
    return (
        cycles.alias("c")
        .join(days.alias("o"), _in_follow_up(), "left")
        .select(*[f"c.{name}" for name in CYCLE_COLUMNS], "o.date", "o.preg_concept")
    )


def range_join_outcomes(cycles: DataFrame, outcome_events: DataFrame) -> DataFrame:
    """The same join keeping every event as its own row.

    A left join cannot be split on its right side, where a person may have very
    many events. So matches come from an inner join, and cycles without a match
    from an anti join against the distinct days. The inner join meets on person
    and calendar month: a cycle is repeated for the months of its follow-up (a
    dozen at most), an event has one. A person's events are thus dealt by time,
    and as both sides are shuffled for this join, AQE can split a month further.
    """
    columns = ("date", "preg_concept")
    month = lambda date: F.trunc(date, "month")
    events = outcome_events.select(
        "person_id", "date", F.col("concept_set").alias("preg_concept"), month(F.col("date")).alias("month")
    )
    months = F.sequence(month(F.col("day_1")), month(F.col("end_preg")), F.expr("interval 1 month"))
    monthly = cycles.withColumn("month", F.explode(months))
    matched = (
        events.alias("o")
        .join(monthly.alias("c"), _in_follow_up() & (F.col("o.month") == F.col("c.month")))
        .select(*[f"c.{name}" for name in CYCLE_COLUMNS], *[f"o.{name}" for name in columns])
    )
    days = outcome_events.select("person_id", "date").distinct()
    unmatched = cycles.alias("c").join(days.alias("o"), _in_follow_up(), "left_anti").select(
        *[f"c.{name}" for name in CYCLE_COLUMNS],
        F.lit(None).cast("date").alias("date"),
        F.lit(None).cast("string").alias("preg_concept"),
    )
    return matched.unionByName(unmatched)


def pivot_outcomes(joined: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Earliest date of each kind per cycle, one column per kind.

    The kinds are listed, so a kind without data gives an all-null column; one
    conditional minimum per kind needs a single combined aggregate.
    """
    return joined.groupBy(*CYCLE_COLUMNS).agg(
        *[F.min(F.when(F.col("preg_concept") == kind, F.col("date"))).alias(kind) for kind in config.outcome_sets]
    )


def outcome_label(config: StudyConfig = StudyConfig(), cycle: str = "") -> str:
    """SQL expression for the outcome of a cycle; the first rule that holds decides.

    The cycle's values are columns, or fields of the struct named ``cycle``.
    """
    c = f"{cycle}." if cycle else ""
    return f"""
        case
          when {c}abortion < date_add({c}day_1, {config.loss_days}) then '{PREGNANCY_LOSS}'
          when {c}stillbirth is not null then '{PREGNANCY_LOSS}'
          when {c}labor is not null then '{LIVE_BIRTH}'
          when cohort_end_date < {c}end_preg then '{CENSORED}'
          when {c}pregnant is not null then '{PREGNANCY}'
          else '{NO_PREGNANCY}' end
        """


def classify_outcomes(pivoted: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Cycle rows with their outcome; needs ``cohort_end_date`` on the row."""
    return pivoted.select(
        "person_id",
        F.col("concept_set").alias("txt"),
        "day_1",
        "cycle",
        "next_cycle",
        "abortion",
        "stillbirth",
        "pregnant",
        "labor",
        F.expr(outcome_label(config)).alias("outcome"),
    )


def cycle_outcomes(
    cycles: DataFrame, days: DataFrame, baseline: DataFrame, config: StudyConfig = StudyConfig()
) -> DataFrame:
    """Range join, pivot and classification from separate tables."""
    pivoted = pivot_outcomes(range_join_days(cycles, days), config)
    return classify_outcomes(pivoted.join(baseline.select("person_id", "cohort_end_date"), "person_id", "left"), config)
