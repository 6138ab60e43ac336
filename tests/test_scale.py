"""Plans and results on tables where one person and one concept hold a third of the rows each."""

import re

import pytest

from cohortloom.plans import registry

from .oracle import compare, connect
from .skew import write_skewed_tables

ROW_LEVEL = ("pull_long_treatments", "pull_long_outcomes", "treatment_dates", "four_cycles")
SKEW_CHECKED = (
    *ROW_LEVEL, "later_treatments", "range_join_outcomes", "pregnancies", "cycle_outcomes", "itt", "union_by_name",
    "cycle_outcomes_relational", "first_treatment", "qc_mixed_cycle", "cohort_generate", "cohort_eras", "pull_all_counts",
    "curve_diff", "top_weights", "ip_weights", "study_stored", "cohort_eras_open", "cohort_nested", "cohort_nested_inclusion",
    "cohort_censoring", "cohort_store", "pull_stored", "pull_pruned", "pregnancies_numbered", "weight_summary_continuous",
    "balance_continuous", "curve_diff_continuous", "concept_closure",
)
NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
SPLIT_SMALL = {
    **NO_BROADCAST,
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
    "spark.sql.files.maxPartitionBytes": "20000",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    return write_skewed_tables(tmp_path_factory.mktemp("skewed"))


@pytest.fixture
def settings(spark):
    changed = {}

    def apply(values):
        for key, value in values.items():
            changed[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)

    yield apply
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", SKEW_CHECKED)
def test_results_on_skewed_tables(spark, skewed, name):
    df = registry.queries()[name](spark, skewed)
    assert compare(df, connect(skewed), registry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", [*ROW_LEVEL, "itt"])
def test_hot_person_is_split_in_row_level_joins(spark, skewed, settings, name):
    settings(SPLIT_SMALL)
    plan = final_plan(registry.queries()[name](spark, skewed))
    assert re.search(r"SortMergeJoin\(skew=true\) \[person_id", plan)


@pytest.mark.parametrize("name", ["itt", "itt_analysis", "pull_all_counts", "cohort_generate"])
def test_one_scan_of_the_big_tables_and_no_python(spark, skewed, settings, name):
    settings(NO_BROADCAST)
    plan = final_plan(registry.queries()[name](spark, skewed))
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1
    assert len(re.findall(r"FileScan parquet \[o_", plan)) == 1
    assert "ReusedExchange" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    lineitem = re.search(r"FileScan parquet \[(l_[^\]]*)\]", plan).group(1)
    assert {re.sub(r"#.*", "", c) for c in lineitem.split(",")} == {"l_orderkey", "l_partkey", "l_shipdate"}


def test_raw_rows_are_hashed_into_days_before_sets_are_collected(spark, skewed, settings):
    settings(NO_BROADCAST)
    plan = final_plan(registry.queries()["itt"](spark, skewed))
    lines = plan.split("\n")
    join = next(n for n, line in enumerate(lines) if "SortMergeJoin" in line and "window_no" in line)
    above = [line for line in lines[:join] if "Aggregate" in line]
    assert "HashAggregate(keys=[person_id" in above[-1] and "ObjectHashAggregate" not in above[-1] and "concept_set" in above[-1]


def test_first_treatment_is_one_pull_by_hashing(spark, skewed, settings):
    settings(NO_BROADCAST)
    plan = final_plan(registry.queries()["first_treatment"](spark, skewed))
    assert plan.count("SortMergeJoin") - plan.count("SortMergeJoin [person_id") - plan.count("SortMergeJoin(skew=true) [person_id") <= 4
    assert len(re.findall(r"SortMergeJoin.*window_no", plan)) == 1
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_hot_person_is_split_in_the_range_join(spark, skewed, settings):
    settings(SPLIT_SMALL)
    plan = final_plan(registry.queries()["range_join_outcomes"](spark, skewed))
    assert re.search(r"SortMergeJoin\(skew=true\) \[person_id", plan)


def test_first_treatments_meet_by_person_and_day(spark, skewed, settings):
    """The entry day is a key of the join, so a hot person's events are dealt by day."""
    settings(SPLIT_SMALL)
    plan = final_plan(registry.queries()["first_treatment"](spark, skewed))
    assert re.search(r"SortMergeJoin(\(skew=true\))? \[date#\d+, person_id#", plan)


@pytest.mark.parametrize("name", ["cycle_outcomes", "itt_rollup", "itt_analysis"])
def test_cycle_steps_are_evaluated_once(spark, skewed, name):
    """Filters pushed below the cycle arrays would repeat the fold per condition."""
    df = registry.queries()[name](spark, skewed)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1


def test_top_weights_are_limited_before_the_shuffle(spark, skewed):
    plan = final_plan(registry.queries()["top_weights"](spark, skewed))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_person_lookup_reaches_the_scan(spark, skewed):
    df = registry.queries()["qc_person_lookup"](spark, skewed)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,14)" in plan
