import pytest

from cohortloom.config import StudyConfig
from cohortloom.operators import cohort as cohort_ops, concepts, cycles, itt, outcomes
from cohortloom.plans import study

from .helpers import cohort, day, events, plus, rows

START = day("2019-03-01")
END = plus(START, 800)
ITT_COLUMNS = ("person_id", "any_pregnancy", "any_live_birth", "delivery_date", "event_delivery", "time_to_delivery")


def fused(spark, data, end=END, config=StudyConfig()):
    return study.person_timelines(events(spark, data), cohort(spark, [(1, START, end)]), config)


def outcome_rows(spark, data, end=END):
    return rows(study.cycle_outcomes(fused(spark, data, end)), "cycle", "txt", "outcome")


def treated(*more, start=START):
    return [(1, start, 1, "ART"), *more]


def test_outcome_on_the_next_cycle_counts_for_both(spark):
    data = treated((1, plus(START, 30), 2, "IUI"), (1, plus(START, 30), 3, "labor"))
    assert outcome_rows(spark, data) == [(1, "ART", "live_birth"), (2, "IUI", "live_birth")]


@pytest.mark.parametrize("days, outcome", [(139, "pregnancy loss"), (140, "no pregnancy")])
def test_abortion_is_a_loss_only_before_twenty_weeks(spark, days, outcome):
    assert outcome_rows(spark, treated((1, plus(START, days), 2, "abortion"))) == [(1, "ART", outcome)]


def test_stillbirth_goes_before_labor_but_the_delivery_counts(spark):
    data = treated((1, plus(START, 250), 2, "labor"), (1, plus(START, 250), 3, "stillbirth"))
    assert outcome_rows(spark, data) == [(1, "ART", "pregnancy loss")]
    assert rows(study.itt_rows(fused(spark, data)), *ITT_COLUMNS) == [(1, 0.0, 0.0, plus(START, 250), True, 250.0)]


def test_follow_up_ending_early_is_censored_even_with_a_pregnancy(spark):
    end = plus(START, 100)
    assert outcome_rows(spark, treated((1, plus(START, 50), 2, "pregnant")), end) == [(1, "ART", "censored")]


def test_pregnancy_without_a_delivery(spark):
    assert outcome_rows(spark, treated((1, plus(START, 50), 2, "pregnant"))) == [(1, "ART", "pregnancy")]


def test_absent_kinds_give_null_columns(spark):
    result = study.cycle_outcomes(fused(spark, treated())).collect()[0]
    assert (result.abortion, result.stillbirth, result.pregnant, result.labor) == (None, None, None, None)
    pivoted = outcomes.pivot_outcomes(
        outcomes.range_join_days(
            cycles.cycle_rows(cycles.anchors_by_person(events(spark, treated()))),
            outcomes.outcome_days(events(spark, [(2, START, 1, "labor")])),
        )
    ).collect()[0]
    assert (pivoted.abortion, pivoted.labor) == (None, None)


def horizon_case(spark, config):
    # three cycles, so that the last follow-up reaches day 424
    data = treated((1, plus(START, 60), 2, "ART"), (1, plus(START, 115), 2, "ART"), (1, plus(START, 424), 3, "labor"))
    return rows(study.itt_rows(fused(spark, data, config=config), config), "event_delivery", "time_to_delivery")


def test_event_at_the_horizon_keeps_its_flag_with_a_cut_time(spark):
    assert horizon_case(spark, StudyConfig()) == [(True, 424.0)]


def test_event_at_the_horizon_can_be_censored(spark):
    assert horizon_case(spark, StudyConfig(late_events="censor")) == [(False, 424.0)]


def test_unknown_end_without_event_has_no_time(spark):
    result = rows(study.itt_rows(fused(spark, treated(), end=None)), "event_delivery", "time_to_delivery")
    assert result == [(False, None)]


def test_event_on_the_entry_day_is_removed(spark):
    kept = study.itt_rows(fused(spark, treated((1, START, 2, "labor"))))
    assert kept.count() == 1
    assert itt.itt_analysis(kept).count() == 0


def test_first_treatment_kinds(spark):
    data = [(1, START, 5, "ART"), (1, START, 7, "IUI"), (1, START, 4, "IUI"), (2, START, 5, "ART"), (4, START, 6, "IUI")]
    people = cohort(spark, [(p, START, END) for p in (1, 2, 3, 4)])
    base = study.baseline(study.person_timelines(events(spark, data), people))
    assert rows(base.where("person_id = 1"), "first_txt", "concept_id_ART", "concept_id_IUI") == [("both", 5, 4)]
    assert rows(base, "person_id", "first_txt") == [(1, "both"), (2, "ART"), (3, "IUI"), (4, "IUI")]
    assert rows(itt.itt_columns(study_itt(spark, data, people)), "person_id", "IUI")[0] == (1, "ART")


def study_itt(spark, data, people):
    rolled = itt.itt_rollup(study.cycle_outcomes(study.person_timelines(events(spark, data), people)))
    base = study.baseline(study.person_timelines(events(spark, data), people))
    return rolled.join(base, "person_id", "full")


def test_person_without_cycles_is_kept(spark):
    people = cohort(spark, [(1, START, END), (2, START, END)])
    timelines = study.person_timelines(events(spark, treated()), people)
    expected = [(1, 0.0), (2, None)]
    key = lambda r: r[0]
    assert sorted(rows(study.itt_rows(timelines), "person_id", "any_pregnancy"), key=key) == expected
    full = itt.itt(itt.itt_rollup(study.cycle_outcomes(timelines)), study.baseline(timelines))
    assert sorted(rows(full, "person_id", "any_pregnancy"), key=key) == expected


def test_two_cohort_rows_of_a_person_fail(spark):
    twice = cohort(spark, [(1, START, END), (1, plus(START, 9), END)])
    with pytest.raises(Exception, match="more than one cohort row for person 1"):
        cohort_ops.cohort_windows(twice).collect()


def test_month_end_windows(spark):
    windows = cohort_ops.cohort_windows(cohort(spark, [(1, day("2019-10-31"), None), (2, day("2020-02-29"), None)]))
    assert rows(windows, "person_id", "covariate_start_date", "txt_end_date") == [
        (1, day("2018-10-31"), day("2020-02-29")),
        (2, day("2019-02-28"), day("2020-06-29")),
    ]


def test_pull_windows_include_both_ends(spark):
    windows = cohort_ops.cohort_windows(cohort(spark, [(1, START, plus(START, 10))]))
    edges = [plus(START, d) for d in (-1, 0, 10, 11)]
    pulls = [p for p in StudyConfig().pulls() if p.concept_set == "labor"]
    pulled = concepts.pull_concept_sets(events(spark, [(1, d, 1, "labor") for d in edges]), windows, pulls)
    assert rows(pulled, "date") == [(edges[1],), (edges[2],)]


def test_study_period_prunes_date_partitions(spark, tmp_path):
    windows = cohort_ops.cohort_windows(cohort(spark, [(1, START, END), (2, plus(START, 40), None)]))
    pulls = StudyConfig().pulls()
    bounds = [day("2018-02-28"), day("2018-03-01"), END, plus(END, 1)]
    path = str(tmp_path / "events")
    events(spark, [(1, d, 1, "labor") for d in bounds]).write.partitionBy("date").parquet(path)
    kept = concepts.within_study_period(spark.read.parquet(path), windows, pulls)
    assert rows(kept, "date") == [(bounds[1],), (bounds[2],)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "Subquery" in plan


def test_indicator_names_are_lower_case(spark):
    windows = cohort_ops.cohort_windows(cohort(spark, [(1, START, END)]))
    pulls = [p for p in StudyConfig().pulls() if not p.keep_all]
    data = [(1, plus(START, -10), 1, "PCOS"), (1, plus(START, -12), 1, "PCOS"), (1, plus(START, 1), 1, "tobacco")]
    result = concepts.pull_indicators(events(spark, data), windows, pulls).collect()
    assert [(r.person_id, r.pcos, r.tobacco) for r in result] == [(1, 1.0, None)]


def test_range_join_keeps_every_event_and_every_cycle(spark):
    treatments = events(spark, [(1, START, 1, "ART"), (2, START, 1, "IUI")])
    found = events(spark, [(1, plus(START, 5), 7, "pregnant")] * 3 + [(1, plus(START, 400), 8, "labor")])
    joined = outcomes.range_join_outcomes(cycles.cycle_rows(cycles.anchors_by_person(treatments)), found)
    assert sorted((r.person_id, r.preg_concept or "") for r in joined.collect()) == [(1, "pregnant")] * 3 + [(2, "")]


def test_unknown_dates_come_last_in_order(spark):
    data = [(1, None, 1, "labor"), (1, plus(START, 1), 1, "labor"), (2, START, 1, "pregnant")]
    ordered = [r.date for r in outcomes.pregnancies(events(spark, data)).collect()]
    assert ordered == [START, plus(START, 1), None]
