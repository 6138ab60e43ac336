"""Sums, last values and ranks along an order, without one task for the whole of it.

Rows are dealt by range of their order and written with the number of their part.
A first pass takes one row per part: its sums, or its last values. What stands
before a part is added up over these rows, of which there are as many as parts,
and joined back; inside a part a window finishes the work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

PART = "part"


def ranged(df: DataFrame, *order: str, label: str = "ranged") -> DataFrame:
    """``df`` dealt by range of ``order`` and written once, with ``part``: parts follow each other as their rows do.

    The sampled borders are only the same within one job, hence the written copy. Rows of
    one key share a part: group equal keys first. Spark merges small parts by size.
    """
    return materialize(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), label)


def _inside(group: Sequence[str], order: str, back: bool) -> W:
    direction = F.col(order).desc() if back else F.col(order).asc()
    return W.partitionBy(*group, PART).orderBy(direction).rowsBetween(W.unboundedPreceding, 0)


def _before(group: Sequence[str], back: bool) -> W:
    direction = F.col(PART).desc() if back else F.col(PART).asc()
    return W.partitionBy(*group).orderBy(direction).rowsBetween(W.unboundedPreceding, -1)


def _joined(stored: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    return stored.join(offsets, [*group, PART])


def running_sums(
    stored: DataFrame, group: Sequence[str], order: str, values: Mapping[str, Column], back: bool = False
) -> DataFrame:
    """``stored`` (see ``ranged``) with the sum of each value over its group's rows up to this one; ``back``: from this one on."""
    names = {name: f"before_{name}" for name in values}
    parts = stored.groupBy(*group, PART).agg(*[F.sum(value).alias(names[name]) for name, value in values.items()])
    earlier = _before(group, back)
    offsets = parts.select(*group, PART, *[F.sum(before).over(earlier).alias(before) for before in names.values()])
    inside = _inside(group, order, back)
    sums = {name: F.coalesce(names[name], F.lit(0.0)) + F.sum(value).over(inside) for name, value in values.items()}
    return _joined(stored, offsets, group).withColumns(sums).drop(*names.values())


def carried(stored: DataFrame, group: Sequence[str], order: str, names: Sequence[str]) -> DataFrame:
    """``stored`` with each named column's last known value at this row, and ``<name>_ends``: the order's last value that knows it."""
    known = {name: F.when(F.col(name).isNotNull(), F.col(order)) for name in names}
    parts = stored.groupBy(*group, PART).agg(
        *[F.max_by(name, at).alias(f"last_{name}") for name, at in known.items()],
        *[F.max(at).alias(f"{name}_ends") for name, at in known.items()],
    )
    earlier, whole = _before(group, False), W.partitionBy(*group)
    offsets = parts.select(
        *group, PART,
        *[F.last(f"last_{name}", ignorenulls=True).over(earlier).alias(f"last_{name}") for name in names],
        *[F.max(f"{name}_ends").over(whole).alias(f"{name}_ends") for name in names],
    )
    inside = _inside(group, order, False)
    held = {name: F.coalesce(F.last(name, ignorenulls=True).over(inside), F.col(f"last_{name}")) for name in names}
    return _joined(stored, offsets, group).withColumns(held).drop(*[f"last_{name}" for name in names])


def value_at_ranks(stored: DataFrame, value: str, count: str, ranks: Sequence[int], sizes: Mapping[int, int]) -> DataFrame:
    """One row, an array of the values at ``ranks`` (from 0) among values that occur ``count`` times each.

    ``sizes`` are the parts' counts. Only the parts that hold a wanted rank are read again.
    """
    targets, before = [], 0
    for part in sorted(sizes):
        targets += [(at, part, rank - before) for at, rank in enumerate(ranks) if before <= rank < before + sizes[part]]
        before += sizes[part]
    wanted = stored.where(F.col(PART).isin(sorted({part for _, part, _ in targets})))
    up_to = F.sum(count).over(_inside((), value, False))
    rows = wanted.withColumn("up_to", up_to)
    found = {
        at: F.max(F.when((F.col(PART) == part) & (F.col("up_to") > rank) & (F.col("up_to") - F.col(count) <= rank), F.col(value)))
        for at, part, rank in targets
    }
    return rows.agg(F.array(*[found[at] for at in range(len(ranks))]).alias("values"))
