import re

from cohortloom.config import StudyConfig
from cohortloom.operators import cohort as cohort_ops, concepts, joins
from cohortloom.plans.registry import COHORT_SPECS
from cohortloom.sources import tables

from .helpers import day, events, plus, rows

START = day("2000-01-01")


def test_concept_sets_take_descendants_and_drop_exclusions(spark):
    items = spark.createDataFrame(
        [("A", 10, True, False), ("A", 2, False, True), ("A", 20, True, True), ("B", 10, False, False), ("B", 2, False, False)],
        "concept_set string, concept_id long, include_descendants boolean, is_excluded boolean",
    )
    ancestors = spark.createDataFrame(
        [(10, 1), (10, 2), (10, 3), (20, 3)], "ancestor_concept_id long, descendant_concept_id long"
    )
    resolved = concepts.resolve_concept_sets(items, ancestors)
    assert rows(resolved, "concept_set", "concept_id") == [("A", 1), ("A", 10), ("B", 2), ("B", 10)]


def test_members_by_id_get_their_names(spark):
    members = spark.createDataFrame([(1125, 7), (332, 8), (9, 9)], "concept_set_id int, concept_id long")
    named = concepts.name_members(members, {"ART": 1125, "pregnant": 332})
    assert rows(named, "concept_set", "concept_id") == [("ART", 7), ("pregnant", 8)]


def test_eras_merge_overlaps_and_touching_days(spark):
    data = [(1, 5, START, plus(START, 10)), (1, 5, plus(START, 10), plus(START, 12)), (1, 5, plus(START, 2), plus(START, 3))]
    data += [(1, 5, plus(START, 13), plus(START, 14)), (2, 5, START, plus(START, 1))]
    frame = spark.createDataFrame(
        data, "cohort_definition_id int, subject_id long, cohort_start_date date, cohort_end_date date"
    )
    names = ("cohort_definition_id", "cohort_start_date", "cohort_end_date")
    assert rows(cohort_ops.collapse_eras(frame), *names) == [
        (1, START, plus(START, 12)),
        (1, plus(START, 13), plus(START, 14)),
        (2, START, plus(START, 1)),
    ]
    assert len(rows(cohort_ops.collapse_eras(frame, gap_days=1), *names)) == 2


def test_open_eras_take_in_all_later_rows(spark):
    days = [START, plus(START, 31), plus(START, 60)]
    data = [(1, 5, days[0], None), (1, 5, days[1], plus(days[1], 3)), (1, 5, days[2], plus(days[2], 3))]
    data += [(1, 6, days[0], plus(days[0], 3)), (1, 6, days[1], None), (1, 6, days[1], plus(days[1], 2))]
    frame = spark.createDataFrame(
        data, "cohort_definition_id int, subject_id long, cohort_start_date date, cohort_end_date date"
    )
    eras = {(r.subject_id, r.cohort_start_date, r.cohort_end_date) for r in cohort_ops.collapse_eras(frame).collect()}
    assert eras == {(5, days[0], None), (6, days[0], plus(days[0], 3)), (6, days[1], None)}


def test_cohort_rules_and_attrition(spark):
    entry = plus(START, 200)
    data = [(p, START, 1, "tobacco") for p in (1, 2, 3)]
    data += [(p, entry, 2, "IUI") for p in (1, 2, 3)] + [(1, plus(entry, -5), 3, "f_infert"), (2, plus(entry, -5), 3, "labor")]
    data += [(4, START, 2, "IUI")]  # no observation before the entry
    days = concepts.event_days(events(spark, data))
    observation = spark.createDataFrame(
        [(p, START, plus(START, 500)) for p in (1, 2, 3, 4)],
        "person_id long, observation_period_start_date date, observation_period_end_date date",
    )
    specs = COHORT_SPECS[:1]
    evaluated = cohort_ops.evaluate_rules(days, observation, specs)
    assert rows(evaluated, "person_id", "inclusion_mask") == [(1, 3), (2, 0), (3, 1)]
    assert rows(cohort_ops.attrition(evaluated, specs), "rule_sequence", "person_count", "drop_count") == [
        (0, 3, 0),
        (1, 2, 1),
        (2, 1, 1),
    ]
    generated = cohort_ops.generate_cohorts(days, observation, specs)
    assert rows(generated, "subject_id", "cohort_start_date", "cohort_end_date") == [(1, entry, plus(START, 500))]
    gain = cohort_ops.rule_gain(evaluated, specs)
    assert rows(gain, "rule_sequence", "person_count", "gain_count", "person_total") == [(1, 2, 0, 3), (2, 1, 1, 3)]
    assert rows(cohort_ops.summary_counts(evaluated, specs), "base_count", "final_count") == [(3, 1)]


def test_results_are_stored_and_read_back(spark, tmp_path):
    entry = plus(START, 200)
    days = concepts.event_days(events(spark, [(1, START, 1, "tobacco"), (1, entry, 2, "IUI"), (1, plus(entry, -5), 3, "f_infert")]))
    observation = spark.createDataFrame(
        [(1, START, plus(START, 500))],
        "person_id long, observation_period_start_date date, observation_period_end_date date",
    )
    results = cohort_ops.cohort_results(days, observation, COHORT_SPECS)
    tables.write_cohort_results(results, str(tmp_path))
    stored = tables.read_cohort_results(spark, str(tmp_path))
    assert stored.keys() == tables.COHORT_TABLES.keys()
    for name, frame in stored.items():
        assert rows(frame, *frame.columns) == rows(results[name], *frame.columns) != []


def test_stored_events_are_read_by_month(spark, tmp_path):
    data = [(p, plus(START, 20 * p), p, "ART") for p in range(30)]
    tables.write_events(events(spark, data).drop("concept_set"), str(tmp_path / "events"))
    tables.write_cohort(
        spark.createDataFrame([(1, 5, plus(START, 100), plus(START, 120)), (2, 6, START, plus(START, 1))], tables.schemas.COHORT),
        str(tmp_path / "cohort"),
    )
    cohort = tables.read_cohort(spark, str(tmp_path / "cohort"), 1)
    windows = cohort_ops.cohort_windows(cohort, StudyConfig(covariate_months=1, treatment_months=1))
    pulls = [pull for pull in StudyConfig().pulls() if pull.concept_set == "ART"]
    inside = concepts.within_study_period(tables.read_events(spark, str(tmp_path / "events")), windows, pulls)
    assert sorted(r.date for r in inside.collect()) == [plus(START, 100), plus(START, 120)]
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= ", plan)


def test_definition_without_rules_takes_every_entry(spark):
    spec = cohort_ops.CohortSpec(7, ("ART",), "1999-01-01", 0, 30)
    observation = spark.createDataFrame(
        [(1, START, plus(START, 9))],
        "person_id long, observation_period_start_date date, observation_period_end_date date",
    )
    days = concepts.event_days(events(spark, [(1, START, 1, "ART"), (1, plus(START, 3), 1, "ART")]))
    generated = cohort_ops.generate_cohorts(days, observation, [spec])
    assert rows(generated, "cohort_definition_id", "cohort_start_date", "cohort_end_date") == [
        (7, START, plus(START, 9))
    ]


def test_cohort_tables_round_trip(spark, tmp_path):
    paths = tables.create_cohort_tables(spark, str(tmp_path))
    assert all(spark.read.parquet(path).count() == 0 for path in paths.values())
    cohort = spark.createDataFrame([(1, 5, START, None), (2, 6, START, START)], tables.schemas.COHORT)
    tables.write_cohort(cohort, paths["cohort"])
    assert rows(tables.read_cohort(spark, paths["cohort"], 2), "subject_id", "cohort_end_date") == [(6, START)]
    stored = tables.read_cohort(spark, paths["cohort"])
    assert stored.count() == 2
    stored.createOrReplaceTempView("stored_cohort")
    assert tables.study_table(spark, "stored_cohort").count() == 2
    assert tables.source_table(spark, "stored_cohort").columns == stored.columns


def test_fold_of_left_joins_and_first_match(spark):
    base = spark.createDataFrame([(1, START), (2, START)], "person_id long, start date")
    left = spark.createDataFrame([(1, 1.0)], "person_id long, a double")
    right = spark.createDataFrame([(2, 1.0)], "person_id long, b double")
    folded = joins.fold_left_joins(base, [left, right], "person_id")
    assert [tuple(r)[2:] for r in folded.orderBy("person_id").collect()] == [(1.0, None), (None, 1.0)]
    many = events(spark, [(1, START, 9, "ART"), (1, START, 4, "ART"), (1, plus(START, 1), 1, "ART")])
    keys = {"person_id": "person_id", "start": "date"}
    matched = joins.left_join_first(base, many, keys, ("concept_id", "concept_set"), "_ART")
    assert matched.columns == ["person_id", "start", "concept_id_ART", "concept_set_ART"]
    assert [r.concept_id_ART for r in matched.orderBy("person_id").collect()] == [4, None]
