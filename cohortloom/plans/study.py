"""The whole study as one plan.

All concept sets are pulled by one join of events and cohort and folded into
one row per person (``person_timelines``). Cycles, their outcomes
and the ITT row are then computed from that row without another shuffle. The
statistics run on ``analysis_cells``, whose number of rows does not grow with
the number of persons.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import StudyConfig
from ..operators import balance, cohort as cohort_ops, concepts, cycles, itt, outcomes, propensity, survival
from ..session import materialize

COHORT_COLUMNS = cohort_ops.WINDOW_COLUMNS
DAY_ARRAYS = {
    "treatment_days": f"array<{cycles.TREATMENT_DAY}>",
    "outcome_days": "array<struct<date:date,concept_set:string>>",
}
ROLLUP_COLUMNS = ("any_pregnancy", "any_live_birth", "delivery_date", "pregnancy_date", "last_cycle", "censored")
BASELINE_EXTRA = ("concept_id_IUI", "concept_set_IUI", "concept_id_ART", "concept_set_ART", "first_txt")


def person_timelines(coded_events: DataFrame, cohort: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """One row per cohort person with everything later steps need.

    Covariates (0/1), the lowest concept id of each treatment on the entry day,
    the treatment days and the outcome days inside their windows. The pull
    leaves a person's rows of one window together, so they are first reduced to
    distinct days and sent on as a few rows per person. The collected sets are
    bounded by the days of the windows, however many events there are.
    Columns that a query does not use are pruned, aggregates included.
    """
    windows = cohort_ops.cohort_windows(cohort, config)
    pulled = concepts.pull_concept_sets(coded_events, windows, config.pulls(), ["cohort_start_date"], numbered=True)
    # raw rows become distinct days by hashing, where the join has left them, before any set is collected
    pulled = pulled.groupBy("person_id", "window_no", "concept_set", "date", "cohort_start_date").agg(
        F.min("concept_id").alias("concept_id")
    )
    kind, date, entry = F.col("concept_set"), F.col("date"), F.col("cohort_start_date")
    indicators = [F.max(F.when(kind == name, 1.0)).alias(name.lower()) for name in config.covariate_sets]
    entry_day = [
        F.min(F.when((kind == name) & (date == entry), F.col("concept_id"))).alias(f"concept_id_{name}")
        for name in config.treatment_sets
    ]
    treatment_day = F.struct(date, cycles.source_order(kind, config).alias("source_order"))
    outcome_day = F.struct(date, kind)
    facts = pulled.groupBy("person_id").agg(
        *indicators,
        *entry_day,
        F.collect_set(F.when(kind.isin(*config.treatment_sets), treatment_day)).alias("treatment_days"),
        F.collect_set(F.when(kind.isin(*config.outcome_sets), outcome_day)).alias("outcome_days"),
    )
    empty = {name: F.coalesce(F.col(name), F.array().cast(kind)) for name, kind in DAY_ARRAYS.items()}
    return windows.join(facts, "person_id", "left").fillna(0.0, list(config.covariates)).withColumns(empty)


def _with_baseline_columns(timelines: DataFrame, config: StudyConfig) -> DataFrame:
    kinds = {
        f"concept_set_{s}": F.when(F.col(f"concept_id_{s}").isNotNull(), F.lit(s)) for s in config.treatment_sets
    }
    return timelines.withColumns({**kinds, "first_txt": itt.first_treatment_label()})


def baseline(timelines: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Cohort row, covariates and first treatment."""
    return _with_baseline_columns(timelines, config).select(*COHORT_COLUMNS, *config.covariates, *BASELINE_EXTRA)


def with_cycles(timelines: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Timelines with ``cycles``: an array of classified cycle structs, empty without treatment.

    The outcome days of a follow-up are picked out of the person's array, so
    the range join of the separate-tables form becomes a row-wise step.
    """
    earliest = ", ".join(
        f"""'{kind}', array_min(filter(outcome_days, d ->
              d.concept_set = '{kind}' and d.date between c.day_1 and c.end_preg).date)"""
        for kind in config.outcome_sets
    )
    dated = f"""
        transform(cycles, c -> named_struct(
          'txt', c.concept_set, 'day_1', c.day_1, 'cycle', c.cycle,
          'next_cycle', c.next_cycle, 'end_preg', c.end_preg, {earliest}))
        """
    classified = f"""
        transform(cycles, c -> named_struct(
          'txt', c.txt, 'day_1', c.day_1, 'cycle', c.cycle, 'next_cycle', c.next_cycle,
          'abortion', c.abortion, 'stillbirth', c.stillbirth, 'pregnant', c.pregnant, 'labor', c.labor,
          'outcome', {outcomes.outcome_label(config, "c")}))
        """
    return (
        timelines.withColumn("anchors", cycles.greedy_anchors("treatment_days", config))
        .withColumn("cycles", cycles.cycle_structs("anchors", config))
        .withColumn("cycles", F.expr(dated))
        .withColumn("cycles", F.expr(classified))
    )


def cycle_outcomes(timelines: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """One classified row per person and cycle, straight from the timelines.

    An outer generator with a filter behind it: for an inner one Spark would
    infer a filter on the array and repeat the cycle steps in it.
    """
    rows = with_cycles(timelines, config).select("person_id", F.inline_outer("cycles"))
    return rows.where(F.col("cycle").isNotNull())


def itt_rows(timelines: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """ITT rows straight from the timelines, persons without a cycle included.

    The roll-up of a person's cycle rows needs no shuffle: the timelines are
    already hashed by person. It also keeps filters on its results above it;
    pushed below, they would repeat the cycle steps for every condition.
    """
    base = [*COHORT_COLUMNS, *config.covariates, *BASELINE_EXTRA]
    listed = with_cycles(_with_baseline_columns(timelines, config), config)
    rolled = listed.select(*base, F.inline_outer("cycles")).groupBy(*base).agg(*itt.rollup_aggregates())
    return itt.itt_columns(rolled.select("person_id", *ROLLUP_COLUMNS, *base[1:]), config)


def analysis_cells(
    analysis: DataFrame,
    config: StudyConfig = StudyConfig(),
    time: str = "time_to_delivery",
    event: str = "event_delivery",
) -> DataFrame:
    """Persons counted by covariates, arm, time and event.

    All that models, weights, balance and curves need. With k 0/1 covariates
    there are at most 2^k x 2 arms x (horizon + 1) days x 2 rows.
    """
    return analysis.groupBy(*config.covariates, "IUI", time, event).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class StudyResult:
    model: propensity.PropensityModel
    cells: DataFrame
    curve: DataFrame
    difference: DataFrame
    balance: DataFrame


def run_study(coded_events: DataFrame, cohort: DataFrame, config: StudyConfig = StudyConfig()) -> StudyResult:
    """Events and cohort to weighted curves.

    ``config.cohort_definition_id`` picks one definition of a stored cohort, before
    anything is read of the others. Events with a ``month`` column are a stored
    table: only the months of the cohort's windows are read. One job reads the events and writes the cells; the model fit, the curves
    and the diagnostics read the cells only.
    """
    if config.cohort_definition_id is not None:
        cohort = cohort.where(F.col("cohort_definition_id") == config.cohort_definition_id)
    if "month" in coded_events.columns:
        windows = cohort_ops.cohort_windows(cohort, config)
        coded_events = concepts.within_study_period(coded_events, windows, config.pulls()).drop("month")
    analysis = itt.itt_analysis(itt_rows(person_timelines(coded_events, cohort, config), config))
    cells = materialize(analysis_cells(analysis, config), "analysis-cells")
    model = propensity.fit_propensity(cells, config.covariates, freq="n")
    weighted = propensity.with_weights(propensity.with_model_scores(cells, model))
    curve = survival.weighted_km(survival.risk_table(weighted, weight="ip_weight", freq="n"), config)
    return StudyResult(
        model=model,
        cells=weighted,
        curve=curve,
        difference=survival.curve_difference(curve, config=config),
        balance=balance.balance_table(weighted, config.covariates, freq="n"),
    )
