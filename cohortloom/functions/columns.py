"""Column helpers whose null rules differ from Spark's built-ins, and name-driven selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way branch; an unknown condition gives null instead of ``no``."""
    return F.when(condition, yes).when(~condition, no)


def least_or_null(*columns: Column) -> Column:
    """Row-wise minimum that is null as soon as one input is null."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    return F.when(known, F.least(*columns))


def select_containing(df: DataFrame, *fragments: str) -> DataFrame:
    """Keep the columns whose name holds one of the fragments, in order of the fragments."""
    names = []
    for fragment in fragments:
        names += [c for c in df.columns if fragment.lower() in c.lower() and c not in names]
    return df.select(*names)


def coalesce_columns(df: DataFrame, names: Sequence[str]) -> Column:
    """First known value over ``names``; columns of unlike types are compared as text."""
    types = {df.schema[name].dataType for name in names}
    if len(types) == 1:
        return F.coalesce(*[F.col(name) for name in names])
    return F.coalesce(*[F.col(name).cast("string") for name in names])


def parse_number(text: Column) -> Column:
    """First number found in a text (grouping commas ignored), as double; null if there is none."""
    digits = F.regexp_extract(text, r"(-?[0-9][0-9,]*(?:\.[0-9]+)?|-?\.[0-9]+)", 1)
    return F.when(digits != "", F.regexp_replace(digits, ",", "")).cast("double")


def flag_labels(df: DataFrame, prefix: str, marker: str) -> list[Column]:
    """Turn each boolean column starting with ``prefix`` into its name without ``marker``.

    A true flag gives the text, anything else null.
    """
    return [
        F.when(F.col(name), F.lit(name.replace(marker, "", 1))).alias(name)
        for name in df.columns
        if name.startswith(prefix)
    ]


def tidy_round(column: Column, digits: int = 6) -> Column:
    """Round and drop the sign of a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
