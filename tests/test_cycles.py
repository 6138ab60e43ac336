from hypothesis import HealthCheck, given, settings, strategies as st

from cohortloom.config import StudyConfig
from cohortloom.operators import cycles, joins

from .helpers import day, events, plus, rows

START = day("2020-01-01")


def annotated(treatments, config=StudyConfig()):
    return cycles.annotate_cycles(treatments.join(cycles.anchors_by_person(treatments, config), "person_id"), config)


def test_day_14_is_inside_and_day_15_opens_the_next_cycle(spark):
    dates = ["2020-01-01", "2020-01-10", "2020-01-15", "2020-01-16", "2020-02-20"]
    treatments = events(spark, [(1, day(d), i, "ART") for i, d in enumerate(dates)])
    cycle = rows(cycles.cycle_rows(cycles.anchors_by_person(treatments)), "cycle", "day_1", "next_cycle", "end_preg")
    assert cycle == [
        (1, day("2020-01-01"), day("2020-01-16"), day("2020-01-16")),
        (2, day("2020-01-16"), day("2020-02-20"), day("2020-02-20")),
        (3, day("2020-02-20"), None, plus(day("2020-02-20"), 315)),
    ]
    flags = rows(cycles.four_cycles(annotated(treatments)), "date", "in_cycle_1", "in_cycle_2", "in_cycle_3")
    assert [f[1:] for f in flags] == [
        (True, False, False),
        (True, False, False),
        (True, False, False),
        (False, True, False),
        (False, False, True),
    ]


def test_rows_after_the_fourth_cycle_are_dropped(spark):
    treatments = events(spark, [(1, plus(START, 20 * i), i, "IUI") for i in range(6)])
    kept = rows(cycles.cycle_number(cycles.four_cycles(annotated(treatments))), "date", "cycle")
    assert kept == [(plus(START, 20 * i), i + 1) for i in range(4)]
    last = rows(cycles.cycle_rows(cycles.anchors_by_person(treatments)), "cycle", "next_cycle")[-1]
    assert last == (4, None)


def test_art_wins_a_tie_on_the_anchor_day(spark):
    treatments = events(spark, [(1, START, 1, "IUI"), (1, START, 9, "ART"), (1, plus(START, 3), 2, "IUI")])
    assert rows(cycles.cycle_rows(cycles.anchors_by_person(treatments)), "concept_set") == [("ART",)]
    numbered = cycles.cycle_number(cycles.four_cycles(annotated(treatments)))
    first = cycles.first_rows(numbered, ["person_id", "cycle"])
    assert rows(first, "concept_set", "concept_id") == [("ART", 9)]


def test_later_course_and_quick_restart(spark):
    treatments = events(
        spark,
        [(1, START, 1, "ART"), (1, plus(START, 16), 2, "IUI"), (1, plus(START, 40), 3, "IUI")]
        + [(2, START, 1, "ART"), (2, plus(START, 21), 2, "IUI")],
    )
    rows_in = annotated(treatments)
    later = cycles.later_treatments(rows_in)
    assert rows(later, "person_id", "date", "day_1b", "in_cycle_1b") == [
        (1, plus(START, 16), plus(START, 16), True),
        (1, plus(START, 40), plus(START, 16), False),
        (2, plus(START, 21), plus(START, 21), True),
    ]
    quick = cycles.quickly_after(later)
    assert rows(quick, "person_id", "concept_id") == [(1, 2)]
    first = cycles.first_rows(joins.restrict_to_persons(cycles.treatment_dates(rows_in), quick), ["person_id"])
    both = first.unionByName(quick, allowMissingColumns=True)
    assert rows(both, "date", "in_cycle_1b") == [(START, None), (plus(START, 16), True)]
    assert rows(cycles.course_gaps(both), "person_id", "gap_days") == [(1, 16)]


def brute_force_cycles(dates, cycle_days=14, max_cycles=4):
    """Row-by-row restatement: date -> cycle number, or nothing beyond the last cycle."""
    anchors, result = [], {}
    for date in sorted(set(dates)):
        if not anchors or date > plus(anchors[-1], cycle_days):
            anchors.append(date)
        if len(anchors) <= max_cycles:
            result[date] = (len(anchors), anchors[-1])
    return result


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.integers(0, 123), min_size=1, max_size=40), min_size=1, max_size=12))
def test_cycles_equal_brute_force(spark, persons):
    data = [(p, plus(START, d), i, "ART") for p, days in enumerate(persons) for i, d in enumerate(days)]
    numbered = cycles.cycle_number(cycles.four_cycles(annotated(events(spark, data))))
    expected = []
    for p, days in enumerate(persons):
        by_date = brute_force_cycles([plus(START, d) for d in days])
        expected += [
            (p, plus(START, d), i, *by_date[plus(START, d)])
            for i, d in enumerate(days)
            if plus(START, d) in by_date
        ]
    assert rows(numbered, "person_id", "date", "concept_id", "cycle", "day_1") == sorted(expected)


def test_four_window_passes_give_the_same_cycles(spark):
    """Re-anchoring pass by pass, as plain window steps."""
    from pyspark.sql import Window as W, functions as F

    data = [(p, plus(START, (p * 37 + i * i * 5) % 124), i, "IUI") for p in range(30) for i in range(9)]
    left, found = events(spark, data), None
    for number in range(1, 5):
        anchored = left.withColumn("day_1", F.min("date").over(W.partitionBy("person_id")))
        inside = F.col("date") <= F.date_add("day_1", 14)
        part = anchored.where(inside).withColumn("cycle", F.lit(number))
        found = part if found is None else found.unionByName(part)
        left = anchored.where(~inside).drop("day_1")
    numbered = cycles.cycle_number(cycles.four_cycles(annotated(events(spark, data))))
    names = ("person_id", "date", "concept_id", "cycle", "day_1")
    assert rows(numbered, *names) == rows(found, *names)
