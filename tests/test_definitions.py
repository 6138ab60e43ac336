"""Nested cohort definitions against plain loops, and the store of cohorts."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohort as ops, concepts
from cohortloom.operators.cohort import Criterion, Group, Rule, all_of, any_of, at_least, none_of
from cohortloom.plans import registry
from cohortloom.sources import tables

from .helpers import day, events, plus, rows

START = day("2000-01-01")
SETS = ("A", "B", "C", "D", "E")


def population(seed=4, persons=60):
    draw = random.Random(seed)
    data = [(p, plus(START, draw.randrange(900)), 1, draw.choice(SETS)) for p in range(persons) for _ in range(draw.randrange(1, 30))]
    observed = [(p, plus(START, draw.randrange(100)), plus(START, 700 + draw.randrange(300))) for p in range(persons)]
    return data, observed


def frames(spark, data, observed):
    observation = spark.createDataFrame(
        observed, "person_id long, observation_period_start_date date, observation_period_end_date date"
    )
    return concepts.event_days(events(spark, data)), observation


def plain_holds(condition, mine, entry):
    if isinstance(condition, Criterion):
        first = -10**6 if condition.first_day is None else condition.first_day
        last = 10**6 if condition.last_day is None else condition.last_day
        hits = [d for d, s in mine if s in condition.concept_sets and first <= (d - entry).days <= last]
        count = len(set(hits)) if condition.distinct_days else len(hits)
        return condition.at_least <= count and (condition.at_most is None or count <= condition.at_most)
    held = sum(plain_holds(member, mine, entry) for member in condition.members)
    if condition.at_least is None and condition.at_most is None:
        return held == len(condition.members)
    return (condition.at_least or 0) <= held and (condition.at_most is None or held <= condition.at_most)


def plain_evaluated(data, observed, spec):
    """(person, entry, outcomes of the rules, first censoring day, end of observation)"""
    out = []
    for person, begin, end in observed:
        mine = [(d, s) for p, d, _, s in data if p == person]
        opens = sorted({d for d, s in mine if s in spec.entry_sets and str(d) >= spec.entry_from and plus(begin, spec.prior_days) <= d <= end})
        for entry in opens[:1] if spec.entries == "first" else opens:
            if spec.entry_if and not plain_holds(spec.entry_if, mine, entry):
                continue
            censor = min((d for d, s in mine if s in spec.censor_sets and d > entry), default=None)
            out.append((person, entry, tuple(plain_holds(r.condition, mine, entry) for r in spec.rules), censor, end))
    return out


def plain_rows(data, observed, spec):
    passed = {}
    for person, entry, held, censor, end in plain_evaluated(data, observed, spec):
        if all(held):
            stop = min(d for d in (end, plus(entry, spec.max_follow_up), censor) if d)
            passed.setdefault(person, []).append((entry, stop))
    out = []
    for person, found in passed.items():
        merged = []
        for entry, stop in sorted(found)[: 1 if spec.rows == "first" else None]:
            if merged and entry <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], stop))
            else:
                merged.append((entry, stop))
        out += [(spec.cohort_definition_id, person, *row) for row in merged]
    return out


NESTED = all_of(
    any_of(Criterion(("B",), -200, 0, at_least=1), none_of(Criterion(("C", "D"), None, -1, at_least=2))),
    at_least(2, Criterion(("E",), 0, None, at_most=1), Criterion(("A",), -100, 100, at_least=2, distinct_days=True), Criterion(("D",), -50, 50, at_least=1)),
)
SPECS = tuple(
    ops.CohortSpec(
        number, ("A", "B"), "2000-03-01", 30, 120, (Rule("nested", NESTED), Rule("few", Group((Criterion(("C",), -300, 0, at_least=1), Criterion(("E",), -300, 0, at_least=1)), at_most=1))),
        entries=entries, rows=kept, entry_if=Criterion(("C",), None, None, at_least=1) if number % 2 else None, censor_sets=("D",) if number > 2 else (),
    )
    for number, (entries, kept) in enumerate([("first", "first"), ("all", "first"), ("all", "all"), ("first", "all"), ("all", "all")], 1)
)


def test_nested_definitions_equal_loops(spark):
    data, observed = population()
    days, observation = frames(spark, data, observed)
    found = ops.generate_cohorts(days, observation, SPECS)
    expected = sorted(row for spec in SPECS for row in plain_rows(data, observed, spec))
    names = ("cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date")
    assert rows(found, *names) == expected
    assert all(sum(row[0] == spec.cohort_definition_id for row in expected) >= 5 for spec in SPECS)
    exits = ops.exit_counts(ops.cohort_exits(ops.evaluate_rules(days, observation, SPECS), SPECS)).collect()
    assert {r.exit_reason for r in exits} == {"censored", "follow-up", "observation"}


def test_more_rules_than_fit_in_a_word(spark):
    data, observed = population(6, 25)
    days, observation = frames(spark, data, observed)
    rules = tuple(Rule(f"rule {n}", Criterion((SETS[n % 5],), -10 * n - 1, 5 * n, at_most=2 + n % 3)) for n in range(130))
    spec = ops.CohortSpec(9, ("A",), "2000-01-01", 0, 60, rules, entries="all", rows="all")
    evaluated = ops.evaluate_rules(days, observation, [spec])
    expected = plain_evaluated(data, observed, spec)
    found = {(r.person_id, r.entry_date): r.inclusion_words for r in evaluated.collect()}
    for person, entry, held, *_ in expected:
        words = found[person, entry]
        assert len(words) == 3
        assert [bool(words[n // ops.WORD_BITS] >> n % ops.WORD_BITS & 1) for n in range(130)] == list(held)
    left = [held for _, _, held, *_ in expected]
    steps = ops.attrition(evaluated, [spec]).orderBy("rule_sequence").collect()
    assert [r.person_count for r in steps] == [sum(all(h[:n]) for h in left) for n in range(131)]
    gain = ops.rule_gain(evaluated, [spec]).orderBy("rule_sequence").collect()
    assert [(r.person_count, r.gain_count) for r in gain] == [
        (sum(h[n] for h in left), sum(not h[n] and all(h[:n]) and all(h[n + 1 :]) for h in left)) for n in range(130)
    ]
    summary = ops.summary_counts(evaluated, [spec]).first()
    assert (summary.base_count, summary.final_count) == (len(left), sum(map(all, left)))


def test_statistics_by_event_and_by_person(spark):
    data, observed = population(7)
    days, observation = frames(spark, data, observed)
    spec = SPECS[1]
    evaluated = ops.evaluate_rules(days, observation, [spec])
    plain = plain_evaluated(data, observed, spec)
    mask = lambda held: sum(bit << n for n, bit in enumerate(held))
    best = {}
    for person, entry, held, *_ in plain:
        key = (-sum(held), entry)
        if person not in best or key < best[person][0]:
            best[person] = key, held
    counted = {(r["mode"], r.inclusion_mask): r.person_count for r in ops.inclusion_by_mode(evaluated).collect()}
    expected = {}
    for mode, outcomes in (("event", [held for _, _, held, *_ in plain]), ("person", [held for _, held in best.values()])):
        for held in outcomes:
            expected[mode, mask(held)] = expected.get((mode, mask(held)), 0) + 1
    assert counted == expected and len(plain) > len(best)


def test_one_pass_over_the_events(spark):
    """All definitions, criteria and censoring share one join and one sort of a person's days."""
    days, observation = frames(spark, *population())
    found = ops.generate_cohorts(days, observation, SPECS)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Python" not in plan and "CartesianProduct" not in plan
    evaluated = ops.evaluate_rules(days, observation, SPECS)
    evaluated.collect()
    plan = evaluated._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Join [person_id") + plan.count("Join(skew=true) [person_id") == 1


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rows_of_all_entries_evaluate_the_rules_once(spark):
    """The branches of exits and rows read written entries; each used to repeat the pass over the days."""
    days, observation = frames(spark, *population())
    assert "Join" not in executed(ops.generate_cohorts(days, observation, SPECS))


def test_stored_entries_deal_persons_by_the_number_of_days(spark, monkeypatch):
    data, observed = population()
    days, observation = frames(spark, data, observed)
    monkeypatch.setattr(ops, "DAYS_TO_A_TASK", 10)
    parts = -(-days.count() // 10)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = executed(ops.evaluate_rules(days, observation, SPECS, parts))
    assert f", {parts}), REPARTITION_BY_NUM" in plan
    names = ("cohort_definition_id", "person_id", "entry_date", "inclusion_mask", "censor_date")
    entries = ops.stored_entries(days, observation, SPECS)
    assert "Exchange" not in executed(entries)
    assert sorted(map(str, rows_of(entries, names))) == sorted(map(str, rows_of(ops.evaluate_rules(days, observation, SPECS), names)))


def rows_of(df, names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def order_tables(spark, folder):
    """Two persons with a claim every ten days, of concepts of all sizes."""
    spark.range(300).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(1, 51).selectExpr("id AS p_partkey", "int(id) AS p_size").write.parquet(f"{folder}/part.parquet")
    lines = "id AS l_orderkey", "id * 7 % 50 + 1 AS l_partkey", "date_add(DATE '1995-01-01', int(id) * 10) AS l_shipdate"
    spark.range(300).selectExpr(*lines).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["cohort_nested", "cohort_censoring", "cohort_nested_attrition", "cohort_nested_inclusion"])
def test_queries_evaluate_once_in_counted_parts(spark, tmp_path, monkeypatch, name):
    calls, evaluate = [], ops.evaluate_rules
    monkeypatch.setattr(ops, "DAYS_TO_A_TASK", 50)
    monkeypatch.setattr(ops, "evaluate_rules", lambda days, observation, specs, parts=None: calls.append(parts) or evaluate(days, observation, specs, parts))
    plan = executed(registry.queries()[name](spark, order_tables(spark, tmp_path)))
    assert calls == [6]
    assert "FileScan parquet [l_" not in plan


def test_tables_of_one_run_read_the_same_written_entries(spark, monkeypatch):
    """Six tables, one evaluation; each table used to repeat it."""
    days, observation = frames(spark, *population())
    calls, evaluate = [], ops.evaluate_rules
    monkeypatch.setattr(ops, "evaluate_rules", lambda *given: calls.append(1) or evaluate(*given))
    made = ops.cohort_results(days, observation, SPECS)
    assert calls == [1] and len(made) == 6
    assert all("observation_period_start_date" not in executed(frame) for frame in made.values())


# ---- the store


def stored_rows(spark, folder):
    return rows(tables.read_cohort(spark, f"{folder}/cohort"), "cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date")


def test_definitions_are_stored_one_by_one(spark, tmp_path):
    data, observed = population()
    days, observation = frames(spark, data, observed)
    folder, calls = str(tmp_path / "store"), []

    def generate(specs):
        calls.append([spec.cohort_definition_id for spec in specs])
        return ops.cohort_results(days, observation, specs)

    expected = {spec.cohort_definition_id: sorted(plain_rows(data, observed, spec)) for spec in SPECS}
    assert tables.store_definitions(spark, folder, SPECS[:1], generate) == [1]
    assert tables.store_definitions(spark, folder, SPECS[1:3], generate) == [2, 3]
    assert stored_rows(spark, folder) == sorted(expected[1] + expected[2] + expected[3])
    assert tables.store_definitions(spark, folder, SPECS[:3], generate) == []
    assert calls == [[1], [2, 3]]
    # a changed definition is replaced, the others' files are not touched
    files = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    changed = replace(SPECS[1], max_follow_up=10)
    assert tables.store_definitions(spark, folder, [SPECS[0], changed, SPECS[2]], generate) == [2]
    assert stored_rows(spark, folder) == sorted(expected[1] + plain_rows(data, observed, changed) + expected[3])
    now = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert all(now[path] == at for path, at in files.items() if f"{tables.DEFINITION}=2" not in path)
    # a definition whose persons are gone loses its rows, and all of its statistics say so
    empty = replace(changed, entry_from="2050-01-01")
    assert tables.store_definitions(spark, folder, [empty], generate) == [2]
    assert stored_rows(spark, folder) == sorted(expected[1] + expected[3])
    manifest = tables.read_manifest(spark, folder)
    assert {number: row.row_count for number, row in manifest.items()} == {1: len(expected[1]), 2: 0, 3: len(expected[3])}
    assert tables.store_definitions(spark, folder, [SPECS[0]], generate, source="new events") == [1]
    with pytest.raises(ValueError, match="one id"):
        tables.store_definitions(spark, folder, [SPECS[0], changed, empty], generate)


def test_broken_write_leaves_the_old_rows(spark, tmp_path):
    data, observed = population()
    days, observation = frames(spark, data, observed)
    folder = str(tmp_path / "store")
    tables.store_definitions(spark, folder, SPECS[:2], lambda specs: ops.cohort_results(days, observation, specs))
    before = stored_rows(spark, folder)

    def broken(specs):
        made = ops.cohort_results(days, observation, specs)
        bad = F.when(F.col("subject_id") >= 0, F.raise_error(F.lit("lost"))).cast("date")
        return made | {"cohort": made["cohort"].withColumn("cohort_end_date", bad)}

    changed = replace(SPECS[0], max_follow_up=3)
    with pytest.raises(Exception, match="lost"):
        tables.store_definitions(spark, folder, [changed], broken)
    with pytest.raises(Exception, match="lost"):
        tables.write_cohort(broken([changed])["cohort"], f"{folder}/cohort")
    assert stored_rows(spark, folder) == before
    assert tables.store_definitions(spark, folder, [changed], lambda specs: ops.cohort_results(days, observation, specs)) == [1]


def test_second_definition_leaves_the_first(spark, tmp_path):
    path = str(tmp_path / "cohort")
    for number in (1, 2, 1):
        tables.write_cohort(spark.createDataFrame([(number, 5 + number, START, None)], tables.schemas.COHORT), path)
    assert rows(tables.read_cohort(spark, path), "cohort_definition_id", "subject_id") == [(1, 6), (2, 7)]
