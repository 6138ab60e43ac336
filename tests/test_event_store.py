"""Events in buckets of persons, Bloom filters at the scan, the closure of parent links."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortloom.config import StudyConfig
from cohortloom.operators import cohort as cohort_ops, concepts, pruning
from cohortloom.sources import event_store

from .helpers import cohort, day, events, plus, rows

START = day("2000-01-01")
CONFIG = StudyConfig()
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
COLUMNS = ("person_id", "date", "concept_id", "concept_set")


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
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def history(spark, persons=60, hot=7, hot_rows=4000):
    """A person with a third of all events or more; two thirds of the persons are in the cohort."""
    draw = random.Random(3)
    sets = [*CONFIG.treatment_sets, *CONFIG.outcome_sets, *CONFIG.covariate_sets]
    data = [(p, plus(START, draw.randrange(900)), draw.randrange(50), draw.choice(sets)) for p in range(persons) for _ in range(60)]
    data += [(hot, plus(START, draw.randrange(900)), draw.randrange(50), draw.choice(sets)) for _ in range(hot_rows)]
    members = [(p, plus(START, draw.randrange(200, 500)), plus(START, 700)) for p in range(persons) if p % 3]
    return events(spark, data), cohort_ops.cohort_windows(cohort(spark, members), CONFIG)


def stored(spark, tmp_path, name):
    coded, windows = history(spark)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{tmp_path}'")
    store = event_store.write_event_store(coded, f"{name}.events", str(tmp_path), 4)
    people = event_store.write_person_table(windows, f"{name}.windows", str(tmp_path), 4)
    return coded, windows, store, people


def test_pull_from_store(spark, tmp_path, settings):
    """No exchange on the events, and the person with very many of them is read in as many tasks as there are files."""
    coded, windows, store, people = stored(spark, tmp_path, "store_a")
    settings(NO_BROADCAST)
    assert [r.person_id for r in spark.table(store.hot_persons).collect()] == [7]
    assert spark.table(store.hot_events).where("person_id <> 7").isEmpty() and spark.table(store.events).where("person_id = 7").isEmpty()
    found = event_store.pull_from_store(spark, store, people, CONFIG.pulls())
    assert rows(found, *COLUMNS) == rows(concepts.pull_concept_sets(coded, windows, CONFIG.pulls()), *COLUMNS)
    plan = final_plan(found)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan
    assert re.search(r"FileScan parquet spark_catalog.store_a.events.*Bucketed: true", plan, re.S)
    # only the few windows of hot persons are sent around
    assert plan.count("BroadcastExchange") <= 2
    spark.sql("DROP DATABASE store_a CASCADE")


def test_months_of_the_store(spark, tmp_path):
    coded, windows, store, people = stored(spark, tmp_path, "store_b")
    months = (day("2000-10-01"), day("2000-12-01"))
    found = event_store.pull_from_store(spark, store, people, CONFIG.pulls(), months)
    expected = concepts.pull_concept_sets(coded, windows, CONFIG.pulls()).where(F.trunc("date", "month").between(*map(F.lit, months)))
    assert rows(found, *COLUMNS) == rows(expected, *COLUMNS) != []
    assert "PartitionFilters: [isnotnull(month" in found._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP DATABASE store_b CASCADE")


def test_hot_persons_are_few(spark, tmp_path):
    """Whatever the data, no more persons are hot than four to a bucket."""
    data = [(p, START, 1, "ART") for p in range(12) for _ in range(2**p)]
    spark.sql(f"CREATE DATABASE store_c LOCATION '{tmp_path}'")
    store = event_store.write_event_store(events(spark, data), "store_c.events", str(tmp_path), 2)
    assert 0 < spark.table(store.hot_persons).count() <= event_store.HOT_PER_BUCKET * 2
    assert spark.table(store.events).count() + spark.table(store.hot_events).count() == len(data)
    spark.sql("DROP DATABASE store_c CASCADE")


# ---- Bloom filters


def test_filter_loses_no_key_and_lets_few_others_through(spark):
    keys = spark.range(0, 30000, 3).union(spark.createDataFrame([(None,)], "id long"))
    bits = pruning.filter_bits(10000)
    words = pruning.bloom_filter(keys, "id", bits)
    judged = spark.range(30000).select("id", pruning.may_hold(words, F.col("id"), bits).alias("held"))
    counts = {r["mine"]: r for r in judged.groupBy((F.col("id") % 3 == 0).alias("mine")).agg(F.count("*").alias("n"), F.count_if("held").alias("held")).collect()}
    assert counts[True].held == counts[True].n == 10000
    assert counts[False].held < 0.03 * counts[False].n
    none = spark.createDataFrame([(None,)], "id long").select(pruning.may_hold(words, F.col("id"), bits))
    assert none.first()[0] is False
    nothing = pruning.bloom_filter(keys.limit(0), "id", pruning.LEAST_BITS)
    assert spark.range(10).where(pruning.may_hold(nothing, F.col("id"), pruning.LEAST_BITS)).count() == 0


def test_filter_size_is_bounded():
    assert pruning.filter_bits(0) == pruning.LEAST_BITS and pruning.filter_bits(10**12) == pruning.MOST_BITS
    assert all(pruning.filter_bits(n) >= min(10 * n, pruning.MOST_BITS) for n in (1, 1000, 10**6))


def test_pruned_events_are_those_of_the_cohort(spark, settings):
    """What is shuffled falls to the rows that are wanted, and the result stays the same."""
    coded, windows = history(spark, persons=300)
    windows = windows.where("person_id < 40")
    members = spark.createDataFrame([("ART", c) for c in range(5)], "concept_set string, concept_id long")
    raw = coded.drop("concept_set")
    pruned = pruning.prune_events(raw, windows, members)
    wanted = raw.join(windows, "person_id", "left_semi").join(members, "concept_id", "left_semi").count()
    assert wanted <= pruned.count() <= 1.05 * wanted + 5 < raw.count() / 5
    pulls = [pull for pull in CONFIG.pulls() if pull.concept_set == "ART"]
    names = ("person_id", "date", "concept_id")
    pull = lambda frame: rows(concepts.pull_concept_sets(concepts.code_events(frame, members), windows, pulls), *names)
    assert pull(pruned) == pull(raw) != []


def test_filters_stand_below_the_first_shuffle(spark, settings):
    settings(NO_BROADCAST)
    coded, windows = history(spark)
    members = spark.createDataFrame([("ART", c) for c in range(5)], "concept_set string, concept_id long")
    coded_again = concepts.code_events(pruning.prune_events(coded.drop("concept_set"), windows, members), members)
    plan = coded_again._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert plan.index("scalar-subquery") > join


# ---- closure


def plain_closure(links):
    known = {n: {n: 0} for link in links for n in link if n is not None}
    for start in known:
        front = {start}
        while front:
            front = {c for p, c in links if p in front and c is not None and c not in known[start]} | set()
            level = max(known[start].values()) + 1
            known[start].update({c: level for c in front})
    return sorted((a, d, level) for a, found in known.items() for d, level in found.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_equals_search(spark, seed):
    """With cycles, own links, repeated links, several parents and null ends."""
    draw = random.Random(seed)
    links = [(draw.randrange(30), draw.randrange(30)) for _ in range(25 * seed)] + [(1, 2), (1, 2), (2, 3), (3, 1), (4, 4), (None, 5), (6, None)]
    frame = spark.createDataFrame(links, "parent_concept_id long, child_concept_id long")
    found = concepts.ancestor_table(frame)
    assert rows(found, "ancestor_concept_id", "descendant_concept_id", "min_levels") == plain_closure(links)
    assert concepts.ancestor_table(frame.limit(0)).collect() == []


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    own = concepts.materialize
    monkeypatch.setattr(concepts, "materialize", lambda df, label: written.append(label) or own(df, label))
    links = spark.range(60).select(F.col("id").alias("parent_concept_id"), (F.col("id") + 1).alias("child_concept_id"))
    found = concepts.ancestor_table(links)
    assert found.agg(F.max("min_levels")).first()[0] == 60 and found.count() == 61 * 62 // 2
    assert len(written) <= 9


def test_sets_resolve_through_the_closure(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "parent_concept_id long, child_concept_id long")
    items = spark.createDataFrame([("A", 1, True, False), ("A", 4, False, True)], "concept_set string, concept_id long, include_descendants boolean, is_excluded boolean")
    assert rows(concepts.resolve_concept_sets(items, concepts.ancestor_table(links)), "concept_id") == [(1,), (2,), (3,)]
