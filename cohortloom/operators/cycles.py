"""Anchored treatment cycles.

A cycle starts on its anchor day and holds the ``cycle_days`` days after it;
the next anchor is the first treatment day beyond that. The anchors of a person
are found once, on distinct treatment days (bounded by the treatment window),
and joined to the treatment rows; no window function runs over raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import StudyConfig
from ..functions.columns import coalesce_columns, flag_labels, parse_number

TREATMENT_DAY = "struct<date:date,source_order:int>"


def source_order(concept_set: Column, config: StudyConfig) -> Column:
    """Rank of a treatment kind on the same day."""
    return F.array_position(F.array(*[F.lit(s) for s in config.treatment_sets]), concept_set).cast("int")


def greedy_anchors(days: str, config: StudyConfig = StudyConfig()) -> Column:
    """Fold an array column of (date, source_order) into the kept anchors, earliest first.

    Each anchor keeps the first treatment kind of its day.
    """
    return F.expr(
        f"""
        aggregate(
          array_sort({days}),
          cast(array() as array<{TREATMENT_DAY}>),
          (kept, day) -> case
            when size(kept) = 0 then array(day)
            when size(kept) < {config.max_cycles}
              and day.date > date_add(element_at(kept, -1).date, {config.cycle_days})
              then concat(kept, array(day))
            else kept end)
        """
    )


def anchors_by_person(treatments: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """One row per person with the array of up to ``max_cycles`` anchors.

    The collected set holds distinct (day, kind) pairs of one treatment window,
    combined before the shuffle: a few hundred at most, however many events.
    """
    day = F.struct(F.col("date"), source_order(F.col("concept_set"), config).alias("source_order"))
    return (
        treatments.where(F.col("date").isNotNull())
        .groupBy("person_id")
        .agg(F.collect_set(day).alias("days"))
        .select("person_id", greedy_anchors("days", config).alias("anchors"))
    )


def annotate_cycles(treatments: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Treatment rows carrying their person's anchors get the number of the cycle they fall in (else null).

    Written out per anchor rather than as an array filter, to stay in generated code.
    """
    anchor_days = [F.try_element_at(F.col("anchors"), F.lit(k))["date"] for k in range(1, config.max_cycles + 1)]
    started = reduce(lambda a, b: a + b, [F.when(day <= F.col("date"), 1).otherwise(0) for day in anchor_days])
    anchor = F.try_element_at(F.col("anchors"), F.col("started"))["date"]
    inside = (F.col("started") > 0) & (F.col("date") <= F.date_add(anchor, config.cycle_days))
    return (
        treatments.withColumn("started", started)
        .withColumn("cycle", F.when(inside, F.col("started")))
        .drop("started")
    )


def _with_first_cycle(annotated: DataFrame, config: StudyConfig) -> DataFrame:
    day_1 = F.try_element_at(F.col("anchors"), F.lit(1))["date"]
    return annotated.withColumn("day_1", day_1).withColumn("day_14", F.date_add("day_1", config.cycle_days))


def treatment_dates(annotated: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Treatment rows with the first cycle's days and whether they fall in it."""
    return _with_first_cycle(annotated, config).select(
        "person_id",
        "date",
        "concept_id",
        "concept_set",
        "day_1",
        "day_14",
        F.col("date").between(F.col("day_1"), F.col("day_14")).alias("in_cycle_1"),
    )


def later_treatments(annotated: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Rows after the first cycle, anchored again on the first of them.

    The new anchor is the person's second one, so no further pass is needed.
    """
    day_1b = F.try_element_at(F.col("anchors"), F.lit(2))["date"]
    return (
        _with_first_cycle(annotated, config)
        .where(F.col("date") > F.col("day_14"))
        .withColumn("day_1b", day_1b)
        .withColumn("day_14b", F.date_add("day_1b", config.cycle_days))
        .select(
            "person_id",
            "date",
            "concept_id",
            "concept_set",
            "day_1",
            "day_14",
            F.lit(False).alias("in_cycle_1"),
            "day_1b",
            "day_14b",
            F.col("date").between(F.col("day_1b"), F.col("day_14b")).alias("in_cycle_1b"),
        )
    )


def first_rows(rows: DataFrame, keys: list[str], config: StudyConfig = StudyConfig()) -> DataFrame:
    """First row per group in order of date, treatment kind and concept.

    A minimum over a struct instead of a row number: groups are reduced before
    the shuffle, so a huge group costs no more than a small one.
    """
    rest = [c for c in rows.columns if c not in (*keys, "date", "concept_id")]
    ordered = F.struct(
        F.col("date"),
        source_order(F.col("concept_set"), config).alias("source_order"),
        F.col("concept_id"),
        *[F.col(c) for c in rest],
    )
    first = rows.groupBy(*keys).agg(F.min(ordered).alias("first_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"first_row.{c}").alias(c) for c in rows.columns])


def quickly_after(later: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """First later row of persons whose new course starts soon after the first one did."""
    soon = F.datediff("day_1b", "day_1") < config.quick_restart_days
    return first_rows(later.where(soon), ["person_id"], config)


def course_gaps(rows: DataFrame) -> DataFrame:
    """Days between a person's first and last row."""
    return rows.groupBy("person_id").agg(F.datediff(F.max("date"), F.min("date")).alias("gap_days"))


def four_cycles(annotated: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Rows inside a kept cycle, with that cycle's days and one flag per cycle."""
    day_1 = F.element_at(F.col("anchors"), F.col("cycle"))["date"]
    flags = [(F.col("cycle") == k).alias(f"in_cycle_{k}") for k in range(1, config.max_cycles + 1)]
    return (
        annotated.where(F.col("cycle").isNotNull())
        .withColumn("day_1", day_1)
        .select(
            "person_id",
            "date",
            "concept_id",
            "concept_set",
            "day_1",
            F.date_add("day_1", config.cycle_days).alias("day_14"),
            *flags,
        )
    )


def cycle_text(flagged: DataFrame) -> DataFrame:
    """Replace the flags by one text column holding the cycle's number."""
    labelled = flag_labels(flagged, "in_cycle_", "in_cycle_")
    names = [c for c in flagged.columns if c.startswith("in_cycle_")]
    kept = [c for c in flagged.columns if c not in names]
    labels = flagged.select(*kept, *labelled)
    return labels.select(*kept, coalesce_columns(labels, names).alias("cycle_text"))


def cycle_number(flagged: DataFrame) -> DataFrame:
    """Replace the flags by the cycle's number."""
    text = cycle_text(flagged)
    return text.withColumn("cycle", parse_number(F.col("cycle_text")).cast("int")).drop("cycle_text")


def cycle_rows(anchors: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """One row per person and cycle: first treatment, anchor, next kept anchor, end of follow-up.

    The next anchor is read from the array, so no window and no sort are needed.
    """
    return anchors.select("person_id", F.inline(cycle_structs("anchors", config))).select(
        "person_id", "concept_set", "day_1", "cycle", "next_cycle", "end_preg"
    )


def cycle_structs(anchors: str, config: StudyConfig = StudyConfig()) -> Column:
    """Array column of anchors -> array of cycles with their follow-up."""
    kinds = ", ".join(f"'{name}'" for name in config.treatment_sets)
    return F.expr(
        f"""
        transform({anchors}, (anchor, i) -> named_struct(
          'concept_set', element_at(array({kinds}), anchor.source_order),
          'day_1', anchor.date,
          'cycle', i + 1,
          'next_cycle', try_element_at({anchors}, i + 2).date,
          'end_preg', coalesce(
            try_element_at({anchors}, i + 2).date, date_add(anchor.date, {config.pregnancy_days}))))
        """
    )
