"""Covariate balance between the arms, before and after weighting.

All functions take rows or counted cells (``freq``), and aggregate to a few
rows per covariate before anything is reshaped. A covariate that holds nothing but 0
and 1 is of kind ``binary``, any other is ``contin.``, the score is ``distance``:
found from the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import scan
from .propensity import MODELLED_ARM

SCORE = "prop.score"
BINARY, CONTINUOUS, DISTANCE = "binary", "contin.", "distance"


def _n(freq: str | None) -> Column:
    return F.col(freq).cast("double") if freq else F.lit(1.0)


def _arms(arm: str) -> dict[str, Column]:
    return {"t": F.col(arm) == MODELLED_ARM, "c": F.col(arm) != MODELLED_ARM}


def covariate_sums(
    weighted: DataFrame, covariates: Sequence[str], arm: str, score: str, weight: str, freq: str | None
) -> DataFrame:
    """One row: per arm the sums of counts, weights and their squares, per arm and covariate those of values and
    squares, and per covariate whether it holds 0 and 1 only. A value that is unknown takes no part."""
    n, w = _n(freq), F.col(weight)
    sums = []
    for key, inside in _arms(arm).items():
        sums += [
            F.sum(F.when(inside, n)).alias(f"n_{key}"),
            F.sum(F.when(inside, n * w)).alias(f"w_{key}"),
            F.sum(F.when(inside, n * w * w)).alias(f"ww_{key}"),
        ]
        for i, column in enumerate((score, *covariates)):
            x = F.col(column).cast("double")
            sums += [
                F.sum(F.when(inside, n * x)).alias(f"x{i}_{key}"),
                F.sum(F.when(inside, n * w * x)).alias(f"wx{i}_{key}"),
                F.sum(F.when(inside, n * x * x)).alias(f"xx{i}_{key}"),
                F.sum(F.when(inside, n * w * x * x)).alias(f"wxx{i}_{key}"),
            ]
    flags = [F.bool_and(F.col(c).isin(0, 1)).alias(f"flag{i}") for i, c in enumerate(covariates, 1)]
    return weighted.agg(*sums, *flags)


def _kind(i: int) -> Column:
    return F.lit(DISTANCE) if i == 0 else F.when(F.coalesce(F.col(f"flag{i}"), F.lit(True)), BINARY).otherwise(CONTINUOUS)


def _difference(kind: str, i: int) -> Column:
    size = "w" if kind == "wx" else "n"
    return F.col(f"{kind}{i}_t") / F.col(f"{size}_t") - F.col(f"{kind}{i}_c") / F.col(f"{size}_c")


def _variance(i: int, key: str) -> Column:
    n, mean = F.col(f"n_{key}"), F.col(f"x{i}_{key}") / F.col(f"n_{key}")
    spread = F.col(f"xx{i}_{key}") - n * mean * mean
    return F.when(n > 1, F.greatest(spread, F.lit(0.0)) / (n - 1))


def _weighted_variance(i: int, key: str) -> Column:
    """Of values with reliability weights: equal to the plain one where all weights are equal."""
    w, mean = F.col(f"w_{key}"), F.col(f"wx{i}_{key}") / F.col(f"w_{key}")
    spread = F.greatest(F.col(f"wxx{i}_{key}") - w * mean * mean, F.lit(0.0))
    free = w - F.col(f"ww_{key}") / w
    return F.when(free > 0, spread / free)


def _scale(i: int) -> Column:
    """What a mean difference is divided by: the pooled unweighted standard deviation, or 1 for 0/1 covariates."""
    pooled = F.sqrt((_variance(i, "t") + _variance(i, "c")) / 2)
    return F.when(_kind(i) == BINARY, 1.0).when(pooled > 0, pooled)


def balance_table(
    weighted: DataFrame,
    covariates: Sequence[str],
    arm: str = "IUI",
    score: str = "p_IUI",
    weight: str = "ip_weight",
    freq: str | None = None,
) -> DataFrame:
    """Mean difference (modelled arm minus other) per covariate, unadjusted and adjusted.

    0/1 covariates: difference of proportions. Score and other covariates: standardised
    by the pooled unweighted standard deviation. All sums come from one aggregate with
    a single result row.
    """
    total = covariate_sums(weighted, covariates, arm, score, weight, freq)
    lines = [
        F.struct(
            F.lit(name).alias("covariate"),
            _kind(i).alias("kind"),
            (_difference("x", i) / _scale(i)).alias("diff_unadjusted"),
            (_difference("wx", i) / _scale(i)).alias("diff_adjusted"),
        )
        for i, name in enumerate((SCORE, *covariates))
    ]
    return total.select(F.inline(F.array(*lines)))


def variance_ratios(
    weighted: DataFrame,
    covariates: Sequence[str],
    arm: str = "IUI",
    score: str = "p_IUI",
    weight: str = "ip_weight",
    freq: str | None = None,
) -> DataFrame:
    """covariate, ratio_unadjusted, ratio_adjusted: variance in the modelled arm over that in the other; unknown for 0/1 covariates."""
    total = covariate_sums(weighted, covariates, arm, score, weight, freq)
    lines = []
    for i, name in enumerate((SCORE, *covariates)):
        spread = {"ratio_unadjusted": _variance, "ratio_adjusted": _weighted_variance}
        ratios = [
            F.when((_kind(i) != BINARY) & (of(i, "c") > 0), of(i, "t") / of(i, "c")).alias(label) for label, of in spread.items()
        ]
        lines.append(F.struct(F.lit(name).alias("covariate"), *ratios))
    return total.select(F.inline(F.array(*lines)))


def distribution_distances(
    weighted: DataFrame,
    covariates: Sequence[str],
    arm: str = "IUI",
    score: str = "p_IUI",
    weight: str = "ip_weight",
    freq: str | None = None,
) -> DataFrame:
    """covariate, ks_unadjusted, ks_adjusted: the largest distance between the arms' distribution functions.

    The functions are running sums over each covariate's distinct values, which are dealt
    by range, so a covariate may have as many values as there are persons.
    """
    n, w = _n(freq), F.col(weight)
    names = {f"v{i}": column for i, column in enumerate((score, *covariates))}
    rows = weighted.where(F.col(arm).isNotNull()).select(
        (F.col(arm) == MODELLED_ARM).alias("treated"), n.alias("n"), (n * w).alias("w"),
        *[F.col(column).cast("double").alias(name) for name, column in names.items()],
    )
    long = rows.unpivot(["treated", "n", "w"], list(names), "covariate", "value").where("value IS NOT NULL")
    per_value = long.groupBy("covariate", "value").agg(*[
        F.sum(F.when(F.col("treated") == side, F.col(size)).otherwise(0.0)).alias(f"{size}_{key}")
        for size in ("n", "w") for key, side in (("t", True), ("c", False))
    ])
    stored = scan.ranged(per_value, "covariate", "value", label="values")
    sums = [f"{size}_{key}" for size in ("n", "w") for key in ("t", "c")]
    totals = stored.groupBy("covariate").agg(*[F.sum(name).alias(f"all_{name}") for name in sums])
    below = scan.running_sums(stored, ["covariate"], "value", {f"below_{name}": F.col(name) for name in sums})
    share = lambda size, key: F.col(f"below_{size}_{key}") / F.col(f"all_{size}_{key}")
    distance = lambda size: F.max(F.abs(share(size, "t") - share(size, "c")))
    found = below.join(totals, "covariate").groupBy("covariate").agg(distance("n").alias("ks_unadjusted"), distance("w").alias("ks_adjusted"))
    label = F.coalesce(*[F.when(F.col("covariate") == key, name) for key, name in zip(names, (SCORE, *covariates))])
    return found.withColumn("covariate", label)


def balance_statistics(
    weighted: DataFrame,
    covariates: Sequence[str],
    arm: str = "IUI",
    score: str = "p_IUI",
    weight: str = "ip_weight",
    freq: str | None = None,
) -> DataFrame:
    """The balance table with variance ratios and distances of distributions beside the differences.

    ``weighted`` is read three times: give it a materialised frame.
    """
    given = (weighted, covariates, arm, score, weight, freq)
    return balance_table(*given).join(variance_ratios(*given), "covariate").join(distribution_distances(*given), "covariate", "left")


def effective_sizes(weighted: DataFrame, arm: str = "IUI", weight: str = "ip_weight", freq: str | None = None) -> DataFrame:
    """Per arm: persons, and the number of equally weighted ones that would be as informative."""
    n, w = _n(freq), F.col(weight)
    sums = weighted.groupBy(F.col(arm).alias("group")).agg(
        F.sum(n).alias("size_unadjusted"), (F.sum(n * w) * F.sum(n * w) / F.sum(n * w * w)).alias("size_adjusted")
    )
    return sums


def balance_long(table: DataFrame) -> DataFrame:
    """Balance table as (covariate, sample, abs_diff) rows."""
    long = table.select("covariate", "diff_unadjusted", "diff_adjusted").unpivot(
        ["covariate"], ["diff_unadjusted", "diff_adjusted"], "sample", "diff"
    )
    return long.select(
        "covariate",
        F.regexp_replace("sample", "diff_", "").alias("sample"),
        F.abs("diff").alias("abs_diff"),
    )


def balance_distribution(
    weighted: DataFrame,
    covariates: Sequence[str],
    arm: str = "IUI",
    score: str = "p_IUI",
    weight: str = "ip_weight",
    freq: str | None = None,
    bins: int = 10,
) -> DataFrame:
    """Share of each level of each covariate within its arm, unweighted and weighted.

    The score is shown in ``bins`` equal bins on [0, 1], numbered from 0. Rows
    are counted per (arm, score bin, covariates) before they are unpivoted.
    """
    n, w = _n(freq), F.col(weight)
    score_bin = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("double")
    counted = weighted.groupBy(F.col(arm).alias("group"), score_bin.alias(SCORE), *covariates).agg(
        F.sum(n).alias("n"), F.sum(n * w).alias("w")
    )
    levels = counted.unpivot(["group", "n", "w"], [f"`{SCORE}`", *covariates], "covariate", "level")
    per_level = levels.groupBy("group", "covariate", "level").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    whole = W.partitionBy("group", "covariate")
    return per_level.select(
        "group",
        "covariate",
        "level",
        (F.col("n") / F.sum("n").over(whole)).alias("share_unadjusted"),
        (F.col("w") / F.sum("w").over(whole)).alias("share_adjusted"),
    )
