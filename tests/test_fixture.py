"""Known totals of the surrogate study."""

import pytest

from cohortloom.plans import registry

EXPECTED = {
    "sf0.001": {
        "cohort": 150,
        "cycles": [150, 81, 27, 2],
        "outcomes": {"censored": 36, "live_birth": 37, "no pregnancy": 124, "pregnancy": 48, "pregnancy loss": 15},
        "first": {"ART": 52, "IUI": 98},
        "arms": {"ART": 52, "IUI": 98},
    },
    "sf0.01": {
        "cohort": 1499,
        "cycles": [1499, 722, 186, 29],
        "outcomes": {"censored": 296, "live_birth": 450, "no pregnancy": 1050, "pregnancy": 344, "pregnancy loss": 296},
        "first": {"ART": 604, "IUI": 892, "both": 3},
        "arms": {"ART": 605, "IUI": 888},
        # by the fitted model, over all persons
        "end": {"ART": (0.605976, 0.021423), "IUI": (0.644974, 0.017212)},
    },
}


def counts(df, *names):
    return {tuple(r)[0]: r["count"] for r in df.groupBy(*names).count().collect()}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_totals(spark, sf):
    expected, folder, queries = EXPECTED[sf], f"/root/testdata/{sf}", registry.queries()
    assert queries["cohort_windows"](spark, folder).count() == expected["cohort"]
    outcomes = queries["cycle_outcomes"](spark, folder).cache()
    assert [n for _, n in sorted(counts(outcomes, "cycle").items())] == expected["cycles"]
    assert counts(outcomes, "outcome") == expected["outcomes"]
    outcomes.unpersist()
    assert counts(queries["baseline"](spark, folder), "first_txt") == expected["first"]
    assert counts(queries["itt_analysis"](spark, folder), "IUI") == expected["arms"]
    if "end" in expected:
        ends = queries["curve_endpoints"](spark, folder).collect()
        assert {r.group: (r.surv, r.se) for r in ends} == expected["end"]
        assert {r.time for r in ends} == {424.0}


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["group", "time", "surv", "se", "ci_lower", "ci_upper"]
    assert {r.group for r in df.collect()} == {"ART", "IUI"}
