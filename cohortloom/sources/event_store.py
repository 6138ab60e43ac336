"""A stored event table that joins by person without a shuffle.

Events lie in months and inside a month in buckets of persons; the cohort's
windows lie in the same buckets. Both are read in place, bucket by bucket. A
bucket cannot be split, so persons with very many events are kept apart: there are
few of them by the rule that picks them, and their windows are sent to every
task that reads their events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import PullSpec
from ..session import materialize

HOT_PER_BUCKET = 4  # a person with more than a bucket's events divided by this is hot


@dataclass(frozen=True)
class EventStore:
    """Names of the tables: events in buckets, events of hot persons, hot persons (at most ``HOT_PER_BUCKET`` * buckets)."""

    events: str
    hot_events: str
    hot_persons: str
    buckets: int


def _save(df: DataFrame, name: str, path: str, buckets: int | None = None, months: bool = False) -> None:
    writer = df.write.mode("overwrite").option("path", f"{path}/{name.split('.')[-1]}")
    if months:
        writer = writer.partitionBy("month")
    if buckets:
        writer = writer.bucketBy(buckets, "person_id").sortBy("person_id")
    writer.saveAsTable(name)


def write_event_store(events: DataFrame, name: str, path: str, buckets: int) -> EventStore:
    """Store (person_id, date, ...) as tables ``name`` and ``name_hot...`` under ``path``, which the executors share.

    A person is hot with more than 1 / (``HOT_PER_BUCKET`` * buckets) of all events. Rows are
    dealt by bucket before the write, so every month has one file a bucket. ``events``
    is read several times: it is written first.
    """
    spark = events.sparkSession
    store = EventStore(name, f"{name}_hot", f"{name}_hot_persons", buckets)
    rows = materialize(events.withColumn("month", F.trunc("date", "month")), "events")
    limit = rows.count() / (HOT_PER_BUCKET * buckets)
    hot = rows.groupBy("person_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("person_id")
    _save(hot.coalesce(1), store.hot_persons, path)
    few = F.broadcast(spark.table(store.hot_persons))
    _save(rows.join(few, "person_id", "left_anti").repartition(buckets, "person_id"), store.events, path, buckets, months=True)
    _save(rows.join(few, "person_id", "left_semi"), store.hot_events, path, months=True)
    return store


def write_person_table(persons: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Store one row per person in the buckets of an event store."""
    _save(persons.repartition(buckets, "person_id"), name, path, buckets)
    return persons.sparkSession.table(name)


def _bound(pulls: Sequence[PullSpec], end: bool) -> Column:
    return F.coalesce(*[F.when(F.col("concept_set") == pull.concept_set, F.col(pull.end_col if end else pull.start_col)) for pull in pulls])


def pull_from_store(spark: SparkSession, store: EventStore, windows: DataFrame, pulls: Sequence[PullSpec], months: tuple | None = None) -> DataFrame:
    """Coded events of all pulled sets inside their windows (see ``concepts.pull_concept_sets``), read bucket by bucket.

    ``windows`` is a table of ``write_person_table``. The join is by person alone and
    every set picks its own window in the row, so the buckets stay usable. ``months``
    (first, last) reads these months' folders only.
    """
    sets = [pull.concept_set for pull in pulls]
    days = sorted({name for pull in pulls for name in (pull.start_col, pull.end_col)})
    dated = windows.select("person_id", *days)

    def inside(events: DataFrame, people: DataFrame) -> DataFrame:
        kept = events.where(F.col("concept_set").isin(sets))
        if months:
            kept = kept.where(F.col("month").between(*(F.lit(month) for month in months)))
        return kept.join(people, "person_id").where(F.col("date").between(_bound(pulls, False), _bound(pulls, True))).select(
            "person_id", "date", "concept_id", "concept_set"
        )

    hot = dated.join(F.broadcast(spark.table(store.hot_persons)), "person_id", "left_semi")
    return inside(spark.table(store.events), dated.hint("merge")).unionByName(inside(spark.table(store.hot_events), F.broadcast(hot)))
