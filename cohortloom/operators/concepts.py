"""Concept sets: membership, and pulling coded events inside per-person date windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PullSpec
from ..session import materialize

EVENT_COLUMNS = ("person_id", "date", "concept_id", "concept_set")


def resolve_concept_sets(items: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Expand set items into (concept_set, concept_id).

    An item stands for itself, and for its descendants where
    ``include_descendants`` is set; whatever the excluded items stand for is
    taken out again. Item lists are short, so Spark sees a small side by size.
    """
    own = items.select("concept_set", "concept_id", "is_excluded")
    descendants = (
        items.where("include_descendants")
        .join(ancestors, F.col("concept_id") == F.col("ancestor_concept_id"))
        .select("concept_set", F.col("descendant_concept_id").alias("concept_id"), "is_excluded")
    )
    # One aggregate instead of distinct + anti join: a concept stays if no
    # excluded item of the same set reaches it.
    return (
        own.unionByName(descendants)
        .groupBy("concept_set", "concept_id")
        .agg(F.bool_or("is_excluded").alias("is_excluded"))
        .where(~F.col("is_excluded"))
        .select("concept_set", "concept_id")
    )


def ancestor_table(links: DataFrame) -> DataFrame:
    """Closure of direct links (parent_concept_id, child_concept_id) as ancestor_concept_id, descendant_concept_id, min_levels.

    Every concept of a link is its own descendant at level 0. Paths double: a round joins
    all known paths end to end, so rounds grow with the logarithm of the
    longest chain. A pair keeps its least level, so cycles end; a round that
    changes nothing is the last. Each round is written, two numbers of it reach the
    driver. A concept with very many children is split by AQE in the join.
    """
    direct = links.where("parent_concept_id IS NOT NULL AND child_concept_id IS NOT NULL AND parent_concept_id <> child_concept_id")
    paths = direct.select(
        F.col("parent_concept_id").alias("ancestor_concept_id"), F.col("child_concept_id").alias("descendant_concept_id"), F.lit(1).alias("min_levels")
    ).distinct()
    paths, mark = materialize(paths, "paths"), None
    while True:
        count = paths.agg(F.count("*"), F.sum("min_levels")).first()
        if count == mark:
            break
        mark = count
        upper = paths.select("ancestor_concept_id", F.col("descendant_concept_id").alias("middle"), F.col("min_levels").alias("above"))
        lower = paths.select(F.col("ancestor_concept_id").alias("middle"), "descendant_concept_id", F.col("min_levels").alias("below"))
        longer = upper.join(lower, "middle").where("ancestor_concept_id <> descendant_concept_id").select(
            "ancestor_concept_id", "descendant_concept_id", (F.col("above") + F.col("below")).alias("min_levels")
        )
        both = paths.unionByName(longer).groupBy("ancestor_concept_id", "descendant_concept_id").agg(F.min("min_levels").alias("min_levels"))
        paths = materialize(both, "paths")
    ends = links.select(F.explode(F.array("parent_concept_id", "child_concept_id")).alias("c")).where("c IS NOT NULL").distinct()
    return paths.unionByName(ends.select(F.col("c").alias("ancestor_concept_id"), F.col("c").alias("descendant_concept_id"), F.lit(0).alias("min_levels")))


def name_members(members: DataFrame, id_by_set: dict[str, int]) -> DataFrame:
    """Membership keyed by set id -> membership keyed by set name; other ids are left out."""
    name = F.coalesce(*[F.when(F.col("concept_set_id") == key, name) for name, key in id_by_set.items()])
    return members.where(F.col("concept_set_id").isin(*id_by_set.values())).select(
        name.alias("concept_set"), "concept_id"
    )


def code_events(events: DataFrame, members: DataFrame) -> DataFrame:
    """Attach the concept set to each event; events of no set drop out.

    No broadcast hint: a membership table that is small enough is broadcast by
    its size, a large one is joined by shuffle with AQE splitting hot concepts.
    """
    stored = [name for name in ("month",) if name in events.columns]
    return events.join(members, "concept_id").select(*EVENT_COLUMNS, *stored)


def person_window_rows(windows: DataFrame, pulls: Sequence[PullSpec], carry: Sequence[str] = ()) -> DataFrame:
    """One row per person and distinct date window of the pulls: window_no, first_day, last_day."""
    bounds = [
        F.struct(F.lit(number).alias("window_no"), F.col(start).alias("first_day"), F.col(end).alias("last_day"))
        for number, (start, end) in enumerate(_distinct_windows(pulls))
    ]
    return windows.select("person_id", *carry, F.inline(F.array(*bounds)))


def _distinct_windows(pulls: Sequence[PullSpec]) -> list[tuple[str, str]]:
    return list(dict.fromkeys((pull.start_col, pull.end_col) for pull in pulls))


def _window_of_set(pulls: Sequence[PullSpec]) -> Column:
    numbers = {window: number for number, window in enumerate(_distinct_windows(pulls))}
    return F.coalesce(
        *[
            F.when(F.col("concept_set") == pull.concept_set, numbers[pull.start_col, pull.end_col])
            for pull in pulls
        ]
    )


def pull_concept_sets(
    coded_events: DataFrame, windows: DataFrame, pulls: Sequence[PullSpec], carry: Sequence[str] = (), numbered: bool = False
) -> DataFrame:
    """Events of all pulled sets inside their windows, one row per event.

    All sets go through one scan and one join, on person and window number; the
    window's days (both included) are checked in the join. With this key neither
    side arrives already partitioned, so both are shuffled for the join and AQE
    can split the rows of a person who owns a large part of them. ``carry``
    names person columns to keep on the rows, which saves a second such join;
    ``numbered`` keeps the window number, by which an aggregate needs no new shuffle.
    """
    names = [pull.concept_set for pull in pulls]
    rows = coded_events.where(F.col("concept_set").isin(*names)).withColumn("window_no", _window_of_set(pulls))
    return (
        rows.join(person_window_rows(windows, pulls, carry), ["person_id", "window_no"])
        .where(F.col("date").between(F.col("first_day"), F.col("last_day")))
        .select(*coded_events.columns, *carry, *["window_no"] * numbered)
    )


def within_study_period(events: DataFrame, windows: DataFrame, pulls: Sequence[PullSpec]) -> DataFrame:
    """Events between the earliest and the latest day of any person's window.

    The window bounds of a pull are only known per person; these two scalars let
    a stored event table that is partitioned or sorted by date skip files: a
    ``month`` column (see ``write_events``) is compared with their months. Use it
    where the cohort is a stored table, as it is read once more for the scalars.
    """
    rows = person_window_rows(windows, pulls)
    period = rows.agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    first_day, last_day = period.select("first_day").scalar(), period.select("last_day").scalar()
    inside = F.col("date").between(first_day, last_day)
    if "month" in events.columns:
        inside &= F.col("month").between(F.trunc(first_day, "month"), F.trunc(last_day, "month"))
    return events.where(inside)


def pull_indicators(coded_events: DataFrame, windows: DataFrame, pulls: Sequence[PullSpec]) -> DataFrame:
    """One row per person with at least one event; one 1.0/null column per set, named in lower case."""
    pulled = pull_concept_sets(coded_events, windows, pulls)
    return pulled.groupBy("person_id").agg(
        *[
            F.max(F.when(F.col("concept_set") == pull.concept_set, 1.0)).alias(pull.concept_set.lower())
            for pull in pulls
        ]
    )


def event_days(coded_events: DataFrame) -> DataFrame:
    """One row per person, set and day: lowest concept id and number of events.

    The aggregate is combined before its shuffle, so a person holding a third
    of all events arrives as at most (days x sets) rows. Windows and joins that
    need a whole person in one place use this frame, never raw events. Where
    date windows apply, pull first: fewer rows are then aggregated.
    """
    return coded_events.groupBy("person_id", "concept_set", "date").agg(
        F.min("concept_id").alias("concept_id"), F.count("*").alias("n_events")
    )


def count_pulls(pulled: DataFrame) -> DataFrame:
    """Events and persons per concept set; per-person counts first, so no distinct list is kept."""
    return (
        pulled.groupBy("concept_set", "person_id")
        .agg(F.count("*").alias("n"))
        .groupBy("concept_set")
        .agg(F.sum("n").alias("n_events"), F.count("*").alias("n_persons"))
    )
