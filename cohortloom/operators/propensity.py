"""Treatment model, propensity scores and inverse probability weights.

The model is fitted by Newton steps over the counted covariate patterns, of any
number and any numeric values. A step makes one vector of every pattern and sums
the outer products of these vectors, block by block and in a tree: one k x k matrix
holds gradient, curvature and deviance, whatever the number of persons, and the
plan stays the same size however many covariates there are. Rows get their score
from an expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.stats import two_sided_p
from ..session import materialize
from . import scan

MODELLED_ARM = "IUI"
INTERCEPT = "(Intercept)"
MAX_STEPS = 50
SMALL_MOVE, LEAST_GAIN = 1e-6, 1e-10  # in standard errors; as a share of the deviance
ALIAS_TOLERANCE = 1e-9  # share of a column's sum of squares that the columns before it must leave open
LEAST_WEIGHT = 1e-200  # a pattern whose score is 0 or 1 to the last digit still has its gradient
NEAR = 1e-6  # fitted probabilities this close to 0 or 1 are reported


def _row_count(freq: str | None) -> Column:
    return F.col(freq).cast("double") if freq else F.lit(1.0)


def patterns(rows: DataFrame, covariates: Sequence[str], arm: str = "IUI", freq: str | None = None) -> DataFrame:
    """One row per covariate pattern: ``x`` (1 for the intercept, then the covariates), ``n`` persons, ``y`` of them in the modelled arm.

    ``freq`` names a count column if the rows are already grouped. Persons without an
    arm or with an unknown covariate take no part.
    """
    n = _row_count(freq)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in covariates], F.col(arm).isNotNull())
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]
    label = F.when(F.col(arm) == MODELLED_ARM, n).otherwise(0.0)
    counted = rows.where(known).groupBy(*values).agg(F.sum(n).alias("n"), F.sum(label).alias("y"))
    return counted.select(F.array(F.lit(1.0), *[f"x{i}" for i in range(len(covariates))]).alias("x"), "n", "y")


def _log1p_exp(x: Column) -> Column:
    """log(1 + exp(x)) for any x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _logistic(x: Column) -> Column:
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def _dot(values: Sequence[float], terms: Column | str = "x") -> Column:
    """Product of a pattern with coefficients. As an array they are data to the plan, so its code is compiled once for all steps."""
    products = F.zip_with(terms, F.lit([float(v) for v in values]), lambda x, value: x * value)
    return F.aggregate(products, F.lit(0.0), lambda total, product: total + product)


def _gram(vectors: Column, rows: DataFrame, size: int) -> np.ndarray:
    """Sum over all rows of the outer product of a row's vector with itself; one matrix to the driver.

    Tasks add into one packed matrix each, and these are combined in a tree.
    """
    column = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vectors).alias("v")), "v")
    return RowMatrix(column, numCols=size).computeGramianMatrix().toArray()


def _independent(matrix: np.ndarray) -> list[int]:
    """Columns that are no combination of those before them, by elimination in order (the first is the intercept)."""
    left, kept = matrix.copy(), []
    for j in range(len(left)):
        if left[j, j] > ALIAS_TOLERANCE * max(matrix[j, j], 1e-300):
            kept.append(j)
            left -= np.outer(left[:, j], left[j]) / left[j, j]
    return kept


@dataclass(frozen=True)
class PropensityModel:
    """Logistic coefficients; a covariate that the intercept and those before it determine has none (and counts as 0)."""

    covariates: tuple[str, ...]
    estimates: dict[str, float | None]
    std_errors: dict[str, float | None]
    statistics: dict[str, float]
    converged: bool = True
    steps: int = 0

    def score(self) -> Column:
        """Probability of the modelled arm as a plain expression: no join, no vectors."""
        used = [c for c in self.covariates if self.estimates[c] is not None]
        terms = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in used])
        return _logistic(_dot([self.estimates[c] for c in (INTERCEPT, *used)], terms))

    def table(self, spark: SparkSession) -> DataFrame:
        """term, estimate, std_error, z_value, p_value."""
        terms = (INTERCEPT, *self.covariates)
        rows = [(t, self.estimates[t], self.std_errors[t]) for t in terms]
        z = F.col("estimate") / F.col("std_error")
        return (
            spark.createDataFrame(rows, "term string, estimate double, std_error double")
            .withColumn("z_value", z)
            .withColumn("p_value", two_sided_p(F.col("z_value")))
        )

    def statistics_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.statistics.items()), "statistic string, value double")

    def positivity(self, scored: DataFrame, arm: str = "IUI", freq: str | None = None, near: float = NEAR) -> DataFrame:
        """Per arm: persons, range of the scores and how many lie within ``near`` of 0 or 1, and whether the fit converged."""
        n, p = _row_count(freq), F.col("p_IUI")
        return scored.where(p.isNotNull()).groupBy(F.col(arm).alias("group")).agg(
            F.sum(n).cast("long").alias("n"),
            F.min(p).alias("min_score"),
            F.max(p).alias("max_score"),
            F.sum(F.when(p < near, n).otherwise(0.0)).cast("long").alias("n_near_zero"),
            F.sum(F.when(p > 1 - near, n).otherwise(0.0)).cast("long").alias("n_near_one"),
        ).withColumn("converged", F.lit(self.converged))


def fit_propensity(
    rows: DataFrame, covariates: Sequence[str], arm: str = "IUI", freq: str | None = None
) -> PropensityModel:
    """Unregularised logistic regression of the arm on numeric covariates.

    Covariates may have any values. Constant ones and combinations of earlier ones get no
    coefficient. A separated fit ends when its deviance stops falling, or
    unconverged after ``MAX_STEPS``: see ``positivity``. One arm alone is an error.
    """
    # kept in memory for the steps; a lost part is read from the written copy again
    grouped = materialize(patterns(rows, covariates, arm, freq), "patterns").persist()
    try:
        return _newton(grouped, tuple(covariates))
    finally:
        grouped.unpersist()


def _newton(grouped: DataFrame, covariates: tuple[str, ...]) -> PropensityModel:
    size = len(covariates) + 1
    x, n, y = F.col("x"), F.col("n"), F.col("y")
    root = F.sqrt("n")
    persons, treated = (total or 0.0 for total in grouped.agg(F.sum("n"), F.sum("y")).first())
    if not 0 < treated < persons:
        raise ValueError("the model needs persons in both arms")
    kept = _independent(_gram(F.transform(x, lambda v: v * root), grouped, size))
    share = treated / persons
    null_deviance = -2 * (treated * np.log(share) + (persons - treated) * np.log1p(-share))
    beta = np.zeros(len(kept))
    beta[0] = np.log(share / (1 - share))
    deviance = np.inf
    for step in range(1, MAX_STEPS + 1):
        full = np.zeros(size)
        full[kept] = beta
        # computed once a row, before the vector is made of them
        linear = grouped.select("x", "n", "y", _dot(full).alias("linear"))
        steps = linear.select("x", (y - n * _logistic(F.col("linear"))).alias("left"), F.sqrt(F.greatest(
            n * _logistic(F.col("linear")) * _logistic(-F.col("linear")), F.lit(LEAST_WEIGHT))).alias("s"),
            F.sqrt(F.greatest(n * _log1p_exp(F.col("linear")) - y * F.col("linear"), F.lit(0.0))).alias("loss"))
        vector = F.concat(F.transform(x, lambda v: v * F.col("s")), F.array(F.col("left") / F.col("s"), F.col("loss")))
        product = _gram(vector, steps, size + 2)
        curvature, gradient = product[np.ix_(kept, kept)], product[kept, size]
        before, deviance = deviance, 2 * product[size + 1, size + 1]
        scale = np.sqrt(np.maximum(np.diag(curvature), 1e-300))
        inverse = np.linalg.pinv(curvature / np.outer(scale, scale), rcond=1e-14) / np.outer(scale, scale)
        move = inverse @ gradient
        beta = beta + move
        # a move this small is squared by the next; a separated fit only stops gaining
        converged = np.max(np.abs(move) * scale) <= SMALL_MOVE or abs(before - deviance) <= LEAST_GAIN * (deviance + 0.1)
        if converged:
            break
    names = [(INTERCEPT, *covariates)[j] for j in kept]
    missing = {c: None for c in covariates}
    statistics = {
        "null_deviance": null_deviance,
        "null_df": persons - 1,
        "residual_deviance": deviance,
        "residual_df": persons - len(kept),
        "aic": deviance + 2 * len(kept),
    }
    errors = np.sqrt(np.maximum(np.diag(inverse), 0.0))
    return PropensityModel(
        covariates,
        missing | dict(zip(names, map(float, beta))),
        missing | dict(zip(names, map(float, errors))),
        {name: float(value) for name, value in statistics.items()},
        bool(converged),
        step,
    )


def with_model_scores(rows: DataFrame, model: PropensityModel) -> DataFrame:
    return rows.withColumn("p_IUI", model.score())


def with_weights(scored: DataFrame, arm: str = "IUI") -> DataFrame:
    """Weight for the average effect in the whole cohort: 1/p in the modelled arm, 1/(1-p) in the other."""
    p = F.col("p_IUI")
    return scored.withColumn(
        "ip_weight", F.when(F.col(arm) == MODELLED_ARM, 1 / p).when(F.col(arm).isNotNull(), 1 / (1 - p))
    )


def score_equations(scored: DataFrame, covariates: Sequence[str], freq: str | None = None) -> DataFrame:
    """Sum of x*p per term; at the maximum it equals the sum of x over the modelled arm."""
    n = _row_count(freq)
    sums = scored.select(
        F.sum(n * F.col("p_IUI")).alias("(Intercept)"),
        *[F.sum(n * F.col(c) * F.col("p_IUI")).alias(c) for c in covariates],
    )
    return sums.unpivot([], ["(Intercept)", *covariates], "term", "score")


QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def weight_summary(weighted: DataFrame, weight: str = "ip_weight", freq: str | None = None) -> DataFrame:
    """Minimum, quartiles, mean and maximum of the weights; exact, however many distinct weights there are.

    Distinct weights are counted and dealt by range. The parts' counts (one row
    each, on the driver) tell which parts hold the wanted ranks; only these
    are looked at again. No known weight gives a row of nulls.
    """
    known = weighted.where(F.col(weight).isNotNull())
    counts = known.groupBy(F.col(weight).cast("double").alias("w")).agg(F.sum(_row_count(freq)).cast("long").alias("n"))
    stored = scan.ranged(counts, "w", label="weights")
    parts = stored.groupBy(scan.PART).agg(F.sum("n").alias("n"), F.sum(F.col("w") * F.col("n")).alias("total")).collect()
    sizes = {row[scan.PART]: row["n"] for row in parts}
    persons = sum(sizes.values())
    if not persons:
        return weighted.sparkSession.createDataFrame([(None,) * 6], "min double, q1 double, median double, mean double, q3 double, max double")
    places = [share * (persons - 1) for share in QUARTILES]
    ranks = [rank for place in places for rank in (math.floor(place), math.ceil(place))]
    found = scan.value_at_ranks(stored, "w", "n", ranks, sizes)
    between = [place - math.floor(place) for place in places]
    low, q1, median, q3, high = (
        F.col("values")[2 * k] * F.lit(1 - share) + F.col("values")[2 * k + 1] * F.lit(share) for k, share in enumerate(between)
    )
    mean = math.fsum(row["total"] for row in parts) / persons
    return found.select(
        low.alias("min"), q1.alias("q1"), median.alias("median"), F.lit(mean).alias("mean"), q3.alias("q3"), high.alias("max")
    )


def weight_diagnostics(
    weighted: DataFrame, arm: str = "IUI", weight: str = "ip_weight", freq: str | None = None
) -> DataFrame:
    """Per arm: size, weight range, coefficient of variation, mean absolute deviation and entropy of
    the weights over their mean, and effective sample size.

    The means come first, one per arm, by a second pass over rows or cells: give it a materialised frame.
    """
    n, w = _row_count(freq), F.col(weight)
    means = weighted.groupBy(F.col(arm).alias("_arm")).agg((F.sum(n * w) / F.sum(n)).alias("_mean"))
    ratio = w / F.col("_mean")
    sums = weighted.join(means, F.col(arm).eqNullSafe(F.col("_arm"))).groupBy(F.col(arm).alias("group")).agg(
        F.sum(n).alias("n"),
        F.min(w).alias("min_weight"),
        F.max(w).alias("max_weight"),
        F.sum(n * w).alias("s1"),
        F.sum(n * w * w).alias("s2"),
        F.sum(n * F.abs(ratio - 1)).alias("s_dev"),
        F.sum(n * F.when(ratio > 0, ratio * F.log(ratio)).otherwise(0.0)).alias("s_log"),
    )
    mean = F.col("s1") / F.col("n")
    variance = F.greatest((F.col("s2") - F.col("n") * mean * mean) / (F.col("n") - 1), F.lit(0.0))
    return sums.select(
        "group",
        F.col("n").cast("long").alias("n"),
        "min_weight",
        "max_weight",
        F.when(F.col("n") > 1, F.sqrt(variance) / mean).alias("cv"),
        (F.col("s_dev") / F.col("n")).alias("mad"),
        (F.col("s_log") / F.col("n")).alias("entropy"),
        (F.col("s1") * F.col("s1") / F.col("s2")).alias("ess"),
    )


def top_weights(
    weighted: DataFrame, k: int = 5, arm: str = "IUI", weight: str = "ip_weight", person: str = "person_id"
) -> DataFrame:
    """The k largest weights per arm. Spark limits each partition to k per arm before the shuffle."""
    order = W.partitionBy("group").orderBy(F.col("ip_weight").desc(), F.col(person))
    return (
        weighted.select(F.col(arm).alias("group"), person, F.col(weight).alias("ip_weight"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def weights_head(weighted: DataFrame, n: int = 6) -> DataFrame:
    """Weights of the first n persons."""
    return weighted.select("person_id", "ip_weight").orderBy("person_id").limit(n)


def weight_vectors(weighted: DataFrame, models: dict[str, PropensityModel], arm: str = "IUI", person: str = "person_id") -> DataFrame:
    """One row per person with the weight by each model, and the largest absolute difference between them."""
    p = {name: model.score() for name, model in models.items()}
    treated = F.col(arm) == MODELLED_ARM
    vectors = {f"weight_{name}": F.when(treated, 1 / score).when(F.col(arm).isNotNull(), 1 / (1 - score)) for name, score in p.items()}
    rows = weighted.select(person, arm, *[column.alias(name) for name, column in vectors.items()])
    spread = F.greatest(*vectors) - F.least(*vectors) if len(vectors) > 1 else F.lit(0.0)
    return rows.withColumn("max_difference", spread)
