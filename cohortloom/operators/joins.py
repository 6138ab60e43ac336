"""Join helpers with a fixed answer where several matches are possible."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def fold_left_joins(base: DataFrame, tables: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Left-join every table onto ``base`` in turn."""
    return reduce(lambda left, right: left.join(right, on, "left"), tables, base)


def left_join_first(
    left: DataFrame,
    right: DataFrame,
    on: dict[str, str],
    values: Sequence[str],
    suffix: str,
) -> DataFrame:
    """Left join that adds at most one match per left row.

    ``on`` maps left key names to right key names. Among several matches the
    lowest ``values`` tuple wins. Added columns are named value + suffix.
    """
    keys = list(on.values())
    first = right.groupBy(*keys).agg(F.min(F.struct(*values)).alias("first_match"))
    matched = first.select(
        *[F.col(r).alias(f"__{r}") for r in keys],
        *[F.col(f"first_match.{v}").alias(v + suffix) for v in values],
    )
    condition = reduce(lambda a, b: a & b, [F.col(l) == F.col(f"__{r}") for l, r in on.items()])
    return left.join(matched, condition, "left").drop(*[f"__{r}" for r in keys])


def restrict_to_persons(df: DataFrame, persons: DataFrame, key: str = "person_id") -> DataFrame:
    """Rows of ``df`` whose person occurs in ``persons``."""
    return df.join(persons.select(key), key, "left_semi")
