"""Named queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import StudyConfig
from ..functions.columns import coalesce_columns as coalesce_columns_of, select_containing, tidy_round
from ..operators import balance, cohort, concepts, cycles, itt, joins, outcomes, propensity, pruning, qc, survival
from ..session import input_bytes, materialize, new_path, size_shuffles, tune
from ..sources import event_store, surrogate, tables
from . import study
from .oracles import oracle_sql as _oracle_sql

CONFIG = StudyConfig()
LOOKUP_PERSON = 14
COHORT_SPECS = (
    cohort.CohortSpec(
        cohort_definition_id=1,
        entry_sets=("ART", "IUI"),
        entry_from="1996-01-01",
        prior_days=180,
        max_follow_up=424,
        rules=(
            cohort.InclusionRule("no delivery in the year before", ("labor",), -365, -1, at_most=0),
            cohort.InclusionRule("infertility on record", ("f_infert", "m_infert"), -730, 0, at_least=1),
        ),
    ),
    cohort.CohortSpec(
        cohort_definition_id=2,
        entry_sets=("ART",),
        entry_from="1997-01-01",
        prior_days=365,
        max_follow_up=600,
        rules=(cohort.InclusionRule("no tobacco use on record", ("tobacco",), -365, 0, at_most=0),),
    ),
)

NESTED_SPECS = (
    cohort.CohortSpec(
        cohort_definition_id=11,
        entry_sets=("ART", "IUI"),
        entry_from="1996-01-01",
        prior_days=180,
        max_follow_up=424,
        entries="all",
        rows="first",
        censor_sets=("stillbirth", "abortion"),
        rules=(
            cohort.Rule(
                "infertility, or PCOS without a delivery",
                cohort.any_of(
                    cohort.Criterion(("f_infert",), -730, 0, at_least=1),
                    cohort.all_of(
                        cohort.Criterion(("PCOS",), -365, 0, at_least=1),
                        cohort.none_of(cohort.Criterion(("labor",), -365, -1, at_least=1)),
                    ),
                ),
            ),
            cohort.Rule(
                "two of: two days of treatment, no tobacco, no alcohol",
                cohort.at_least(
                    2,
                    cohort.Criterion(("ART", "IUI"), -180, -1, at_least=2, distinct_days=True),
                    cohort.Criterion(("tobacco",), -365, 0, at_most=0),
                    cohort.Criterion(("alcohol",), -365, 0, at_most=0),
                ),
            ),
        ),
    ),
    cohort.CohortSpec(
        cohort_definition_id=12,
        entry_sets=("ART",),
        entry_from="1997-01-01",
        prior_days=365,
        max_follow_up=90,
        entries="all",
        rows="all",
        entry_if=cohort.Criterion(("IUI",), None, -1, at_least=1),
        censor_sets=("labor",),
        rules=(
            cohort.Rule(
                "no loss after a pregnancy",
                cohort.none_of(
                    cohort.all_of(
                        cohort.Criterion(("abortion", "stillbirth"), -365, -1, at_least=1),
                        cohort.Criterion(("pregnant",), -365, -1, at_least=1),
                    )
                ),
            ),
        ),
    ),
)
CONTINUOUS = ("n_prior", "years_before")
STORE_BUCKETS = 8

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


class Inputs:
    """Lazy study inputs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        stored = sum(input_bytes(spark, f"{sf_dir}/{name}.parquet") for name in surrogate.EVENT_TABLES)
        self.spark = size_shuffles(tune(spark), stored)
        self.coded = concepts.code_events(
            surrogate.clinical_events(spark, sf_dir), surrogate.concept_members(spark, sf_dir)
        )
        self.cohort = surrogate.cohort(self.coded)
        self.sf_dir = sf_dir
        self._fitted = None

    def windows(self) -> DataFrame:
        return cohort.cohort_windows(self.cohort, CONFIG)

    def pulls(self, sets: tuple[str, ...]):
        return [pull for pull in CONFIG.pulls() if pull.concept_set in sets]

    def pulled(self, *sets: str) -> DataFrame:
        """Every event of the sets inside its window."""
        return concepts.pull_concept_sets(self.coded, self.windows(), self.pulls(sets))

    def stored_pull(self, *sets: str) -> DataFrame:
        """The pulled rows, written once: for queries that branch on them."""
        return materialize(self.pulled(*sets), "pulled")

    def stored_treatment_days(self) -> DataFrame:
        """Distinct treatment days, written once: for results that need no single events."""
        return materialize(concepts.event_days(self.pulled(*CONFIG.treatment_sets)), "treatment-days")

    def annotated(self) -> DataFrame:
        """Every treatment row with its person's anchors and its cycle.

        Rows and anchors are both read from storage, so the join is a broadcast
        if the anchors are small and otherwise one that AQE can split.
        """
        rows = self.stored_pull(*CONFIG.treatment_sets)
        anchors = materialize(cycles.anchors_by_person(rows, CONFIG), "anchors")
        return cycles.annotate_cycles(rows.join(anchors, "person_id"), CONFIG)

    def annotated_days(self) -> DataFrame:
        days = self.stored_treatment_days()
        return cycles.annotate_cycles(days.join(cycles.anchors_by_person(days, CONFIG), "person_id"), CONFIG)

    def cycles_and_outcomes(self) -> tuple[DataFrame, DataFrame]:
        """Cycle rows and outcome events from one pull."""
        rows = self.stored_pull(*CONFIG.treatment_sets, *CONFIG.outcome_sets)
        kind = F.col("concept_set")
        anchors = cycles.anchors_by_person(rows.where(kind.isin(*CONFIG.treatment_sets)), CONFIG)
        return cycles.cycle_rows(anchors, CONFIG), rows.where(kind.isin(*CONFIG.outcome_sets))

    def timelines(self) -> DataFrame:
        return study.person_timelines(self.coded, self.cohort, CONFIG)

    def itt(self) -> DataFrame:
        return study.itt_rows(self.timelines(), CONFIG)

    def analysis(self) -> DataFrame:
        return itt.itt_analysis(self.itt())

    def cells_and_model(self) -> tuple[DataFrame, propensity.PropensityModel]:
        """Analysis cells, written once, and the model fitted on them."""
        if self._fitted is None:
            cells = materialize(study.analysis_cells(self.analysis(), CONFIG), "analysis-cells")
            self._fitted = cells, propensity.fit_propensity(cells, CONFIG.covariates, freq="n")
        return self._fitted

    def weighted_cells(self) -> DataFrame:
        """Analysis cells with weights by the fitted model."""
        cells, model = self.cells_and_model()
        return propensity.with_weights(propensity.with_model_scores(cells, model))

    def analysis_rows(self) -> DataFrame:
        """One narrow row per person of the analysis, written once."""
        return materialize(self.analysis().select("person_id", "IUI", *CONFIG.covariates), "analysis")

    def weighted_rows(self) -> DataFrame:
        """One weighted row per person: the model is fitted on the rows' patterns and scores them by expression."""
        rows = self.analysis_rows()
        model = propensity.fit_propensity(rows, CONFIG.covariates)
        return propensity.with_weights(propensity.with_model_scores(rows, model))

    def curve(self) -> DataFrame:
        risk = survival.risk_parts(self.weighted_cells(), weight="ip_weight", freq="n")
        return survival.weighted_km(risk, CONFIG)

    def history(self) -> DataFrame:
        """Per cohort person: events before the entry day, and years from the first of them to it (0 without any)."""
        days = concepts.event_days(self.coded).select("person_id", "date", "n_events")
        start = self.cohort.select(F.col("subject_id").alias("person_id"), "cohort_start_date")
        before = days.join(start, "person_id").where(F.col("date") < F.col("cohort_start_date"))
        years = F.datediff(F.first("cohort_start_date"), F.min("date")) / 365.25
        found = before.groupBy("person_id").agg(F.sum("n_events").cast("double").alias("n_prior"), years.alias("years_before"))
        return start.select("person_id").join(found, "person_id", "left").fillna(0.0, list(CONTINUOUS))

    def continuous_rows(self) -> tuple[DataFrame, propensity.PropensityModel]:
        """One row per person of the analysis with two covariates of many values, weighted by their model, and times between the days."""
        rows = self.analysis().select("person_id", "IUI", *CONFIG.covariates, "time_to_delivery", "event_delivery")
        fine = F.col("time_to_delivery") + F.col("person_id") % 997 / 997.0
        rows = materialize(rows.join(self.history(), "person_id").withColumn("fine_time", fine), "continuous")
        model = propensity.fit_propensity(rows, CONTINUOUS)
        return propensity.with_weights(propensity.with_model_scores(rows, model)), model

    def fine_curve(self) -> DataFrame:
        rows, _ = self.continuous_rows()
        return survival.weighted_km(survival.risk_parts(rows, time="fine_time", weight="ip_weight"), CONFIG)


def query(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    _queries[function.__name__] = lambda spark, sf_dir: function(Inputs(spark, sf_dir))
    return function


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: tidy_round(F.col(name), digits) for name in names})


# ---- cohort and concept sets


@query
def cohort_scan(study_in: Inputs) -> DataFrame:
    """Store the generated cohort and scan it by definition."""
    path = new_path(study_in.spark, "cohort")
    tables.write_cohort(study_in.cohort, path)
    return tables.read_cohort(study_in.spark, path, surrogate.COHORT_DEFINITION_ID)


@query
def cohort_windows(study_in: Inputs) -> DataFrame:
    return study_in.windows()


@query
def cohort_generate(study_in: Inputs) -> DataFrame:
    days = concepts.event_days(study_in.coded)
    return cohort.generate_cohorts(days, surrogate.observation_period(study_in.coded), COHORT_SPECS)


def evaluated_rules(study_in: Inputs, specs=COHORT_SPECS) -> DataFrame:
    """Entries of the definitions, written once. First and last days are read off the stored days, which hold every event's day."""
    days = materialize(concepts.event_days(study_in.coded), "days")
    return cohort.stored_entries(days, surrogate.observation_period(days), specs)


@query
def cohort_stats(study_in: Inputs) -> DataFrame:
    return cohort.attrition(evaluated_rules(study_in), COHORT_SPECS)


@query
def cohort_inclusion(study_in: Inputs) -> DataFrame:
    return cohort.inclusion_counts(evaluated_rules(study_in)).drop("inclusion_words")


@query
def cohort_nested(study_in: Inputs) -> DataFrame:
    """Definitions of nested groups, with censoring events and several entries per person."""
    return cohort.cohort_rows(cohort.cohort_exits(evaluated_rules(study_in, NESTED_SPECS), NESTED_SPECS), NESTED_SPECS)


@query
def cohort_nested_inclusion(study_in: Inputs) -> DataFrame:
    """Rule outcomes of the nested definitions by event and by person."""
    evaluated = evaluated_rules(study_in, NESTED_SPECS)
    return cohort.inclusion_by_mode(evaluated).drop("inclusion_words")


@query
def cohort_nested_attrition(study_in: Inputs) -> DataFrame:
    """Attrition of the nested definitions, each person's best entry counted."""
    evaluated = evaluated_rules(study_in, NESTED_SPECS)
    return cohort.attrition(cohort.best_events(evaluated), NESTED_SPECS)


@query
def cohort_censoring(study_in: Inputs) -> DataFrame:
    """What ends the time in the cohorts of the nested definitions."""
    return cohort.exit_counts(cohort.cohort_exits(evaluated_rules(study_in, NESTED_SPECS), NESTED_SPECS))


@query
def cohort_store(study_in: Inputs) -> DataFrame:
    """Two definitions stored one after the other, then the first changed: rows of the store, and what its manifest says."""
    days = materialize(concepts.event_days(study_in.coded), "days")
    observation = materialize(surrogate.observation_period(days), "observation")
    spark, folder = study_in.spark, new_path(study_in.spark, "store")
    first, second = COHORT_SPECS

    def generate(specs):
        return cohort.cohort_results(days, observation, specs)

    tables.store_definitions(spark, folder, [first], generate)
    tables.store_definitions(spark, folder, [first, second], generate)
    tables.store_definitions(spark, folder, [replace(first, max_follow_up=100), second], generate)
    manifest = spark.read.schema(tables.schemas.COHORT_MANIFEST).parquet(f"{folder}/{tables.MANIFEST}")
    return tables.read_cohort(spark, f"{folder}/cohort").join(manifest.select("cohort_definition_id", "row_count"), "cohort_definition_id")


@query
def cohort_catalog(study_in: Inputs) -> DataFrame:
    """The cohort as a table of a study schema in the session's catalog, scanned by schema and name."""
    path = new_path(study_in.spark, "schema")
    schema = f"study_{path.rsplit('-', 1)[1]}"
    study_in.spark.sql(f"CREATE DATABASE {schema} LOCATION '{path}'")
    study_in.cohort.write.option("path", f"{path}/cohort").saveAsTable(f"{schema}.cohort")
    return tables.study_table(study_in.spark, "cohort", replace(CONFIG, write_schema=schema))


def _stored_results(study_in: Inputs) -> dict[str, DataFrame]:
    """Generate all definitions, store cohort and statistics, and read them back."""
    days = materialize(concepts.event_days(study_in.coded), "days")
    observation = materialize(surrogate.observation_period(days), "observation")
    folder = new_path(study_in.spark, "cohorts")
    tables.write_cohort_results(cohort.cohort_results(days, observation, COHORT_SPECS), folder)
    return tables.read_cohort_results(study_in.spark, folder)


@query
def cohort_rule_gain(study_in: Inputs) -> DataFrame:
    """Stored statistics: what each rule keeps out."""
    return _stored_results(study_in)["cohort_rule_gain"]


@query
def cohort_summary(study_in: Inputs) -> DataFrame:
    """Stored statistics: first and last count of each definition, with the rows of the stored cohort beside them."""
    stored = _stored_results(study_in)
    rows = stored["cohort"].groupBy("cohort_definition_id").agg(F.count("*").alias("stored_rows"))
    return stored["cohort_summary"].join(rows, "cohort_definition_id", "left")


def _treatment_periods(study_in: Inputs) -> DataFrame:
    treatment_days = concepts.event_days(
        study_in.coded.where(F.col("concept_set").isin(*CONFIG.treatment_sets))
    )
    return treatment_days.join(surrogate.observation_period(study_in.coded), "person_id").select(
        F.lit(1).alias("cohort_definition_id"),
        F.col("person_id").alias("subject_id"),
        F.col("date").alias("cohort_start_date"),
        F.least("observation_period_end_date", F.date_add("date", 60)).alias("cohort_end_date"),
    )


@query
def cohort_eras(study_in: Inputs) -> DataFrame:
    return cohort.collapse_eras(_treatment_periods(study_in))


@query
def cohort_eras_open(study_in: Inputs) -> DataFrame:
    """The same where periods that start on the first of a month have no known end."""
    known = F.when(F.dayofmonth("cohort_start_date") > 1, F.col("cohort_end_date"))
    return cohort.collapse_eras(_treatment_periods(study_in).withColumn("cohort_end_date", known))


@query
def concept_set_resolve(study_in: Inputs) -> DataFrame:
    spark, sf_dir = study_in.spark, study_in.sf_dir
    return concepts.resolve_concept_sets(
        surrogate.concept_set_items(spark, sf_dir), surrogate.concept_ancestor(spark, sf_dir)
    )


@query
def concept_closure(study_in: Inputs) -> DataFrame:
    """Ancestors of every concept from direct parent links only."""
    return concepts.ancestor_table(surrogate.concept_links(study_in.spark, study_in.sf_dir))


@query
def pull_long_treatments(study_in: Inputs) -> DataFrame:
    return study_in.pulled(*CONFIG.treatment_sets)


@query
def pull_long_outcomes(study_in: Inputs) -> DataFrame:
    return study_in.pulled(*CONFIG.outcome_sets)


@query
def pull_indicator(study_in: Inputs) -> DataFrame:
    pulls = [pull for pull in CONFIG.pulls() if not pull.keep_all]
    return concepts.pull_indicators(study_in.coded, study_in.windows(), pulls)


@query
def pull_all_counts(study_in: Inputs) -> DataFrame:
    """All twelve pulls as one job."""
    sets = [pull.concept_set for pull in CONFIG.pulls()]
    return concepts.count_pulls(study_in.pulled(*sets))


@query
def pull_stored(study_in: Inputs) -> DataFrame:
    """Treatments and outcomes from an event store in buckets of persons."""
    spark, path = study_in.spark, new_path(study_in.spark, "event-store")
    schema = f"events_{path.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{path}'")
    store = event_store.write_event_store(study_in.coded, f"{schema}.events", path, STORE_BUCKETS)
    windows = event_store.write_person_table(study_in.windows(), f"{schema}.windows", path, STORE_BUCKETS)
    return event_store.pull_from_store(spark, store, windows, study_in.pulls((*CONFIG.treatment_sets, *CONFIG.outcome_sets)))


@query
def pull_pruned(study_in: Inputs) -> DataFrame:
    """Outcomes of the second definition's cohort; Bloom filters of its persons and of the sets' concepts are applied at the scan."""
    spark, sf_dir = study_in.spark, study_in.sf_dir
    days = concepts.event_days(study_in.coded)
    entered = cohort.generate_cohorts(days, surrogate.observation_period(study_in.coded), COHORT_SPECS[1:])
    windows = materialize(cohort.cohort_windows(entered, CONFIG), "windows")
    members = surrogate.concept_members(spark, sf_dir).where(F.col("concept_set").isin(*CONFIG.outcome_sets))
    members = materialize(members, "members")
    events = pruning.prune_events(surrogate.clinical_events(spark, sf_dir), windows, members)
    return concepts.pull_concept_sets(concepts.code_events(events, members), windows, study_in.pulls(CONFIG.outcome_sets))


@query
def baseline(study_in: Inputs) -> DataFrame:
    return study.baseline(study_in.timelines(), CONFIG)


@query
def first_treatment(study_in: Inputs) -> DataFrame:
    """Left join with at most one match per set on the entry day: the lowest concept of each, from one pull of both sets."""
    windows = study_in.windows()
    pulled = concepts.pull_concept_sets(study_in.coded, windows, study_in.pulls(CONFIG.treatment_sets), ["cohort_start_date"])
    on_entry = pulled.where(F.col("date") == F.col("cohort_start_date"))
    lowest = {
        f"concept_id_{name}": F.min(F.when(F.col("concept_set") == name, F.col("concept_id"))) for name in ("IUI", "ART")
    }
    matches = on_entry.groupBy("person_id").agg(*[column.alias(name) for name, column in lowest.items()])
    rows = windows.select("person_id", "cohort_start_date").join(matches, "person_id", "left")
    for name in ("IUI", "ART"):
        rows = rows.withColumn(f"concept_set_{name}", F.when(F.col(f"concept_id_{name}").isNotNull(), F.lit(name)))
    return rows.withColumn("first_txt", itt.first_treatment_label())


# ---- treatments and cycles


@query
def treatment_dates(study_in: Inputs) -> DataFrame:
    return cycles.treatment_dates(study_in.annotated(), CONFIG)


@query
def later_treatments(study_in: Inputs) -> DataFrame:
    return cycles.later_treatments(study_in.annotated(), CONFIG)


@query
def quickly_after(study_in: Inputs) -> DataFrame:
    later = cycles.later_treatments(study_in.annotated_days(), CONFIG)
    return cycles.quickly_after(later, CONFIG)


@query
def union_by_name(study_in: Inputs) -> DataFrame:
    """First row of each course for persons with a quick second course."""
    annotated = study_in.annotated_days()
    quick = cycles.quickly_after(cycles.later_treatments(annotated, CONFIG), CONFIG)
    dated = cycles.treatment_dates(annotated, CONFIG)
    first = cycles.first_rows(joins.restrict_to_persons(dated, quick), ["person_id"], CONFIG)
    return first.unionByName(quick, allowMissingColumns=True)


@query
def second_course_gap(study_in: Inputs) -> DataFrame:
    return cycles.course_gaps(union_by_name(study_in))


@query
def four_cycles(study_in: Inputs) -> DataFrame:
    return cycles.four_cycles(study_in.annotated(), CONFIG)


@query
def coalesce_columns(study_in: Inputs) -> DataFrame:
    return cycles.cycle_text(four_cycles(study_in))


@query
def coalesce_unlike(study_in: Inputs) -> DataFrame:
    """First known value over a number and a text column: the lowest IUI concept of the entry day, else the name of the set."""
    rows = study.baseline(study_in.timelines(), CONFIG).select("person_id", "concept_id_IUI", "concept_set_ART")
    return rows.withColumn("first_known", coalesce_columns_of(rows, ["concept_id_IUI", "concept_set_ART"]))


@query
def cycle_number(study_in: Inputs) -> DataFrame:
    return cycles.cycle_number(four_cycles(study_in))


@query
def first_row_per_cycle(study_in: Inputs) -> DataFrame:
    numbered = cycles.cycle_number(cycles.four_cycles(study_in.annotated_days(), CONFIG))
    return cycles.first_rows(numbered, ["person_id", "cycle"], CONFIG)


@query
def cycle_followup(study_in: Inputs) -> DataFrame:
    anchors = cycles.anchors_by_person(study_in.pulled(*CONFIG.treatment_sets), CONFIG)
    return cycles.cycle_rows(anchors, CONFIG)


# ---- outcomes


@query
def pregnancies(study_in: Inputs) -> DataFrame:
    return outcomes.pregnancies(study_in.pulled(*CONFIG.outcome_sets), CONFIG)


@query
def pregnancies_numbered(study_in: Inputs) -> DataFrame:
    """The same with each row's place in that order."""
    return outcomes.numbered_pregnancies(study_in.pulled(*CONFIG.outcome_sets), CONFIG)


@query
def range_join_outcomes(study_in: Inputs) -> DataFrame:
    cycle_rows, events = study_in.cycles_and_outcomes()
    return outcomes.range_join_outcomes(materialize(cycle_rows, "cycles"), events)


@query
def pivot_outcomes(study_in: Inputs) -> DataFrame:
    cycle_rows, events = study_in.cycles_and_outcomes()
    return outcomes.pivot_outcomes(outcomes.range_join_days(cycle_rows, outcomes.outcome_days(events)), CONFIG)


@query
def cycle_outcomes(study_in: Inputs) -> DataFrame:
    return study.cycle_outcomes(study_in.timelines(), CONFIG)


@query
def cycle_outcomes_relational(study_in: Inputs) -> DataFrame:
    """The same from separate tables: lead, range join, pivot, left join."""
    cycle_rows, events = study_in.cycles_and_outcomes()
    return outcomes.cycle_outcomes(cycle_rows, outcomes.outcome_days(events), study_in.windows(), CONFIG)


@query
def itt_rollup(study_in: Inputs) -> DataFrame:
    return itt.itt_rollup(study.cycle_outcomes(study_in.timelines(), CONFIG))


@query
def itt_(study_in: Inputs) -> DataFrame:
    return study_in.itt()


@query
def itt_full_join(study_in: Inputs) -> DataFrame:
    """The same by rolling up cycle rows and a full join with the baseline."""
    timelines = materialize(study_in.timelines(), "timelines")
    rollup = itt.itt_rollup(study.cycle_outcomes(timelines, CONFIG))
    return itt.itt(rollup, study.baseline(timelines, CONFIG), CONFIG)


@query
def itt_analysis(study_in: Inputs) -> DataFrame:
    return study_in.analysis()


# ---- spot checks


@query
def qc_both_treated(study_in: Inputs) -> DataFrame:
    return qc.both_treated(baseline(study_in))


@query
def qc_pregnancy_counts(study_in: Inputs) -> DataFrame:
    return qc.outcome_counts(study_in.pulled(*CONFIG.outcome_sets))


@query
def qc_person_lookup(study_in: Inputs) -> DataFrame:
    return qc.person_rows(study_in.pulled(*CONFIG.outcome_sets), LOOKUP_PERSON)


@query
def qc_person_treatments(study_in: Inputs) -> DataFrame:
    return qc.person_rows(study_in.pulled(*CONFIG.treatment_sets), LOOKUP_PERSON)


@query
def qc_person_cycles(study_in: Inputs) -> DataFrame:
    return qc.person_rows(cycle_outcomes(study_in), LOOKUP_PERSON)


@query
def qc_person_itt(study_in: Inputs) -> DataFrame:
    return qc.person_rows(study_in.itt(), LOOKUP_PERSON)


@query
def qc_mixed_cycle(study_in: Inputs) -> DataFrame:
    return qc.mixed_first_cycle(study_in.annotated_days(), freq="n_events")


@query
def qc_event_columns(study_in: Inputs) -> DataFrame:
    return select_containing(study_in.itt(), "event", "time")


# ---- weights


@query
def propensity_score_equations(study_in: Inputs) -> DataFrame:
    cells, model = study_in.cells_and_model()
    scored = propensity.with_model_scores(cells, model)
    return rounded(propensity.score_equations(scored, CONFIG.covariates, freq="n"), "score", digits=4)


@query
def propensity_coefficients(study_in: Inputs) -> DataFrame:
    table = study_in.cells_and_model()[1].table(study_in.spark)
    return rounded(rounded(table, "estimate", "std_error", "p_value"), "z_value", digits=4)


@query
def propensity_statistics(study_in: Inputs) -> DataFrame:
    """Deviances, degrees of freedom and AIC of the fitted model."""
    return rounded(study_in.cells_and_model()[1].statistics_table(study_in.spark), "value", digits=5)


@query
def propensity_positivity(study_in: Inputs) -> DataFrame:
    """Scores near 0 or 1, and whether the fit converged."""
    cells, model = study_in.cells_and_model()
    report = model.positivity(propensity.with_model_scores(cells, model), freq="n")
    return rounded(report, "min_score", "max_score")


@query
def propensity_aliased(study_in: Inputs) -> DataFrame:
    """The fit with a constant and a determined covariate beside the others: these get no coefficient."""
    extra = {"no_tobacco": 1 - F.col("tobacco"), "constant": F.lit(2.5)}
    rows = study_in.analysis_rows().withColumns(extra)
    model = propensity.fit_propensity(rows, (*CONFIG.covariates, *extra))
    return rounded(model.table(study_in.spark).select("term", "estimate"), "estimate")


@query
def ip_weights(study_in: Inputs) -> DataFrame:
    weighted = study_in.weighted_rows().select("person_id", "IUI", "p_IUI", "ip_weight")
    return rounded(weighted, "p_IUI", "ip_weight")


@query
def weight_summary(study_in: Inputs) -> DataFrame:
    summary = propensity.weight_summary(study_in.weighted_cells(), freq="n")
    return rounded(summary, *summary.columns)


@query
def weight_diagnostics(study_in: Inputs) -> DataFrame:
    diagnostics = propensity.weight_diagnostics(study_in.weighted_cells(), freq="n")
    return rounded(diagnostics, "min_weight", "max_weight", "cv", "mad", "entropy", "ess")


@query
def top_weights(study_in: Inputs) -> DataFrame:
    return rounded(propensity.top_weights(study_in.weighted_rows()), "ip_weight")


@query
def weights_head(study_in: Inputs) -> DataFrame:
    return rounded(propensity.weights_head(study_in.weighted_rows()), "ip_weight")


@query
def weight_vectors(study_in: Inputs) -> DataFrame:
    """Each person's weight by the model of single rows and by that of counted cells."""
    rows = study_in.analysis_rows()
    models = {"rows": propensity.fit_propensity(rows, CONFIG.covariates), "cells": study_in.cells_and_model()[1]}
    return rounded(propensity.weight_vectors(rows, models), "weight_rows", "weight_cells", "max_difference")


@query
def propensity_continuous(study_in: Inputs) -> DataFrame:
    """The model on two covariates of many values."""
    table = study_in.continuous_rows()[1].table(study_in.spark)
    return rounded(table.select("term", "estimate", "std_error"), "estimate", "std_error")


@query
def weight_summary_continuous(study_in: Inputs) -> DataFrame:
    """Quartiles of weights that are nearly all distinct."""
    summary = propensity.weight_summary(study_in.continuous_rows()[0])
    return rounded(summary, *summary.columns)


# ---- curves and balance


@query
def km_risk_table(study_in: Inputs) -> DataFrame:
    risk = survival.risk_table(study_in.weighted_cells(), weight="ip_weight", freq="n")
    return rounded(risk, "w_event", "w_leaving", "w2_leaving", "at_risk", "at_risk_sq", digits=4)


@query
def iptw_km(study_in: Inputs) -> DataFrame:
    return rounded(study_in.curve(), "surv", "se", "ci_lower", "ci_upper")


@query
def curve_endpoints(study_in: Inputs) -> DataFrame:
    return rounded(survival.curve_endpoints(study_in.curve()), "surv", "se", "ci_lower", "ci_upper")


@query
def curve_diff(study_in: Inputs) -> DataFrame:
    difference = survival.curve_difference(study_in.curve(), config=CONFIG)
    return rounded(difference, "diff", "se", "ci_lower", "ci_upper", "p_value")


@query
def balance_table(study_in: Inputs) -> DataFrame:
    table = balance.balance_table(study_in.weighted_cells(), CONFIG.covariates, freq="n")
    return rounded(table, "diff_unadjusted", "diff_adjusted")


@query
def balance_distribution(study_in: Inputs) -> DataFrame:
    shares = balance.balance_distribution(study_in.weighted_cells(), CONFIG.covariates, freq="n")
    return rounded(shares, "share_unadjusted", "share_adjusted")


@query
def km_continuous(study_in: Inputs) -> DataFrame:
    """Curves over times that are not cut to days."""
    return rounded(study_in.fine_curve(), "time", "surv", "se", "ci_lower", "ci_upper")


@query
def curve_diff_continuous(study_in: Inputs) -> DataFrame:
    difference = survival.curve_difference(study_in.fine_curve(), config=CONFIG)
    return rounded(difference, "time", "diff", "se", "ci_lower", "ci_upper", "p_value")


@query
def balance_continuous(study_in: Inputs) -> DataFrame:
    """Differences, variance ratios and distances of distributions, with covariates of both kinds."""
    rows = materialize(study_in.continuous_rows()[0], "weighted")
    table = balance.balance_statistics(rows, (*CONFIG.covariates, *CONTINUOUS))
    return rounded(table, *[name for name in table.columns if name not in ("covariate", "kind")])


@query
def balance_sizes(study_in: Inputs) -> DataFrame:
    sizes = balance.effective_sizes(study_in.weighted_cells(), freq="n")
    return rounded(sizes, "size_unadjusted", "size_adjusted", digits=4)


@query
def balance_long(study_in: Inputs) -> DataFrame:
    table = balance.balance_table(study_in.weighted_cells(), CONFIG.covariates, freq="n")
    return rounded(balance.balance_long(table), "abs_diff")


@query
def iptw_km_glm(study_in: Inputs) -> DataFrame:
    """The whole study with model weights: delivery-free curves by arm."""
    curve = study.run_study(study_in.coded, study_in.cohort, CONFIG).curve
    return rounded(curve, "surv", "se", "ci_lower", "ci_upper")


@query
def study_stored(study_in: Inputs) -> DataFrame:
    """The same from stored tables: one definition of the stored cohort, and only the months of its windows."""
    spark, path = study_in.spark, new_path(study_in.spark, "stored")
    tables.write_cohort(study_in.cohort, f"{path}/cohort")
    tables.write_events(surrogate.clinical_events(spark, study_in.sf_dir), f"{path}/events")
    members = surrogate.concept_members(spark, study_in.sf_dir)
    coded = concepts.code_events(tables.read_events(spark, f"{path}/events"), members)
    config = replace(CONFIG, cohort_definition_id=surrogate.COHORT_DEFINITION_ID)
    curve = study.run_study(coded, tables.read_cohort(spark, f"{path}/cohort"), config).curve
    return rounded(curve, "surv", "se", "ci_lower", "ci_upper")


_queries["itt"] = _queries.pop("itt_")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return _oracle_sql(LOOKUP_PERSON)
