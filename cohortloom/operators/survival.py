"""Weighted Kaplan-Meier curves and their difference.

Times may be any numbers, and as many as there are persons: sums over an arm's
times, and the values a curve holds, run over ranges of times (see ``scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import StudyConfig
from ..functions.stats import two_sided_p
from ..session import materialize
from . import scan


def _leaving(rows: DataFrame, arm: str, time: str, event: str, weight: str | None, freq: str | None) -> DataFrame:
    n = F.col(freq).cast("double") if freq else F.lit(1.0)
    w = F.col(weight) if weight else F.lit(1.0)
    happened = F.col(event)
    return (
        rows.where(F.col(time).isNotNull() & F.col(arm).isNotNull())
        .groupBy(F.col(arm).alias("group"), F.col(time).cast("double").alias("time"))
        .agg(
            F.sum(n).alias("n_leaving"),
            F.sum(F.when(happened, n).otherwise(0.0)).alias("n_event"),
            F.sum(F.when(happened, n * w).otherwise(0.0)).alias("w_event"),
            F.sum(n * w).alias("w_leaving"),
            F.sum(n * w * w).alias("w2_leaving"),
        )
    )


def risk_parts(
    rows: DataFrame,
    arm: str = "IUI",
    time: str = "time_to_delivery",
    event: str = "event_delivery",
    weight: str | None = None,
    freq: str | None = None,
) -> DataFrame:
    """The risk table with ``part``, the range of times a row was dealt to: what ``weighted_km`` takes without dealing again."""
    stored = scan.ranged(_leaving(rows, arm, time, event, weight, freq), "group", "time", label="leaving")
    at_risk = {"at_risk": F.col("w_leaving"), "at_risk_sq": F.col("w2_leaving")}
    return scan.running_sums(stored, ["group"], "time", at_risk, back=True)


def risk_table(
    rows: DataFrame,
    arm: str = "IUI",
    time: str = "time_to_delivery",
    event: str = "event_delivery",
    weight: str | None = None,
    freq: str | None = None,
) -> DataFrame:
    """Per arm and time: persons, events and weights leaving, and the weight still at risk.

    Persons without a time (unknown end of follow-up) are left out. ``weight``
    defaults to 1; ``freq`` names a count column of already grouped rows.
    """
    return risk_parts(rows, arm, time, event, weight, freq).drop(scan.PART)


def weighted_km(risk: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Survival curve per arm at time 0, every event time and the arm's last time.

    Once all remaining weight has had the event the curve is 0 and its variance
    undefined (null). The product is a sum of logarithms, so it adds up over
    ranges of times.
    """
    if scan.PART in risk.columns:
        stored = materialize(risk, "risk")
    else:
        stored = scan.ranged(risk, "group", "time", label="risk")
    at_risk, event = F.col("at_risk"), F.col("w_event")
    # d and Y are sums in different order: a remainder of rounding size counts as none
    exhausted = at_risk - event <= at_risk * 1e-9
    effective = at_risk * at_risk / F.col("at_risk_sq")
    steps = {
        "exhausted": F.when(exhausted, 1.0).otherwise(0.0),
        "log_surv": F.when(exhausted, 0.0).otherwise(F.log1p(-event / at_risk)),
        "hazard_var": F.when(exhausted, 0.0).otherwise(event / (effective * (at_risk - event))),
    }
    arms = stored.groupBy("group").agg(
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.max("at_risk").alias("at_risk")
    )
    summed = scan.running_sums(stored, ["group"], "time", steps)
    curve = summed.join(arms.select("group", "last_time"), "group").where(
        (F.col("time") == 0) | (F.col("n_event") > 0) | (F.col("time") == F.col("last_time"))
    )
    points = curve.select(
        "group", "time", F.when(F.col("exhausted") > 0, 0.0).otherwise(F.exp("log_surv")).alias("surv"), "hazard_var"
    )
    nobody = F.col("at_risk") <= 0
    origin = arms.where("first_time > 0").select(
        "group", F.lit(0.0).alias("time"), F.when(nobody, 0.0).otherwise(1.0).alias("surv"), F.lit(0.0).alias("hazard_var")
    )
    se = F.when(F.col("surv") > 0, F.col("surv") * F.sqrt("hazard_var"))
    return origin.unionByName(points).withColumn("se", se).select(
        "group",
        "time",
        "surv",
        "se",
        (F.col("surv") - config.z * F.col("se")).alias("ci_lower"),
        (F.col("surv") + config.z * F.col("se")).alias("ci_upper"),
    )


def curve_endpoints(curve: DataFrame) -> DataFrame:
    """Rows of each arm's last time."""
    ends = F.max(F.struct("time", F.struct(*curve.columns).alias("row"))).alias("last")
    return curve.groupBy("group").agg(ends).select("last.row.*")


def curve_difference(
    curve: DataFrame, first: str = "ART", second: str = "IUI", config: StudyConfig = StudyConfig()
) -> DataFrame:
    """Difference of two step curves (first minus second) at every time of either.

    Each curve holds its last value until its next step and is unknown after its
    last time. What a curve holds is carried from one range of times to the next.
    """
    point = F.struct("surv", "se")
    arms = {"a": first, "b": second}
    by_time = curve.groupBy("time").agg(
        *[F.min(F.when(F.col("group") == name, point)).alias(key) for key, name in arms.items()],
    )
    compared = by_time.withColumn("arms", F.lit(f"{first} - {second}"))
    stored = scan.ranged(compared, "time", label="curve-times")

    def held(key: str) -> Column:
        return F.when(F.col("time") <= F.col(f"{key}_ends"), F.col(key)).alias(key)

    aligned = scan.carried(stored, ["arms"], "time", list(arms)).select("time", *[held(key) for key in arms])
    difference = aligned.select(
        "time",
        (F.col("a.surv") - F.col("b.surv")).alias("diff"),
        F.sqrt(F.col("a.se") * F.col("a.se") + F.col("b.se") * F.col("b.se")).alias("se"),
    )
    z = F.when(F.col("se") > 0, F.col("diff") / F.col("se"))
    return difference.select(
        "time",
        "diff",
        "se",
        (F.col("diff") - config.z * F.col("se")).alias("ci_lower"),
        (F.col("diff") + config.z * F.col("se")).alias("ci_upper"),
        two_sided_p(z).alias("p_value"),
    )
