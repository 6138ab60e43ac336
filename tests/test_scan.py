"""Running sums, carried values and ranks over ranges; curves, quantiles and balance on values that are nearly all distinct."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import balance, propensity, scan, survival
from cohortloom.plans import registry

from .test_statistics import kaplan_meier

MANY_PARTS = {
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "7",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(params=[{}, MANY_PARTS], ids=["as-it-is", "many-parts"])
def parts(spark, request):
    before = {key: spark.conf.get(key, None) for key in request.param}
    for key, value in request.param.items():
        spark.conf.set(key, value)
    yield len(request.param)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_running_sums(spark, parts):
    rng = np.random.default_rng(1)
    data = [(g, float(t), float(v)) for g in ("a", "b") for t, v in enumerate(rng.normal(size=300))]
    stored = scan.ranged(spark.createDataFrame(data, "g string, t double, v double"), "g", "t")
    assert not parts or stored.select("part").distinct().count() > 3
    for back in (False, True):
        found = {(r.g, r.t): r.s for r in scan.running_sums(stored, ["g"], "t", {"s": F.col("v")}, back=back).collect()}
        for g in ("a", "b"):
            values = np.array([v for name, _, v in data if name == g])
            sums = np.cumsum(values[::-1])[::-1] if back else np.cumsum(values)
            assert [found[g, float(t)] for t in range(300)] == pytest.approx(sums.tolist())


def test_carried_values(spark, parts):
    rng = np.random.default_rng(2)
    data = [("x", float(t), int(v) if v < 3 else None, 7 if t == 5 else None) for t, v in enumerate(rng.integers(0, 40, 200))]
    stored = scan.ranged(spark.createDataFrame(data, "g string, t double, a int, b int"), "t")
    found = scan.carried(stored, ["g"], "t", ["a", "b"]).orderBy("t").collect()
    last = None
    for row, (_, t, a, _) in zip(found, data):
        last = a if a is not None else last
        assert (row.a, row.b, row.b_ends) == (last, 7 if t >= 5 else None, 5.0)
    assert found[0].a_ends == max(t for _, t, a, _ in data if a is not None)


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_quartiles_of_distinct_weights(spark, parts, n):
    rng = np.random.default_rng(n)
    weights = rng.gamma(2.0, size=n)
    times = rng.integers(1, 4, n)
    rows = spark.createDataFrame([(float(w), int(k)) for w, k in zip(weights, times)] + [(None, 5)], "ip_weight double, n int")
    every = np.repeat(weights, times)
    found = propensity.weight_summary(rows, freq="n").first()
    expected = [*np.quantile(every, [0, 0.25, 0.5]), every.mean(), *np.quantile(every, [0.75, 1])]
    assert list(found) == pytest.approx(expected)
    assert list(propensity.weight_summary(rows.where("ip_weight IS NULL")).first()) == [None] * 6


def test_quartiles_read_the_wanted_parts_only(spark):
    """No aggregate holds all values; the second pass names the parts it reads."""
    rows = spark.range(5000).select((F.col("id") * 0.37).alias("ip_weight")).repartition(4)
    before = {key: spark.conf.get(key, None) for key in MANY_PARTS}
    for key, value in MANY_PARTS.items():
        spark.conf.set(key, value)
    plan = final_plan(propensity.weight_summary(rows))
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "percentile" not in plan and "ObjectHashAggregate" not in plan
    assert "PushedFilters: [In(part, [" in plan


def continuous_people(n=900):
    rng = np.random.default_rng(8)
    arm = rng.random(n) < 0.45
    time = np.round(rng.exponential(50, n), 7) + arm * 0.25
    return arm, time, rng.random(n) < 0.6, 1 / rng.uniform(0.2, 0.9, n), rng.normal(arm * 0.4, 1 + 0.5 * arm), (rng.random(n) < 0.3).astype(float)


def people_frame(spark):
    arm, time, event, weight, x, flag = continuous_people()
    data = [("IUI" if a else "ART", float(t), bool(e), float(w), 0.5, float(v), float(f)) for a, t, e, w, v, f in zip(arm, time, event, weight, x, flag)]
    schema = "IUI string, time_to_delivery double, event_delivery boolean, ip_weight double, p_IUI double, x double, flag double"
    return spark.createDataFrame(data, schema)


def test_curves_over_distinct_times(spark, parts):
    arm, time, event, weight, *_ = continuous_people()
    rows = people_frame(spark)
    curve = survival.weighted_km(survival.risk_parts(rows, weight="ip_weight"))
    again = survival.weighted_km(survival.risk_table(rows, weight="ip_weight"))
    points = {}
    for name, inside in (("IUI", arm), ("ART", ~arm)):
        expected = kaplan_meier(time[inside], event[inside], weight[inside])
        for frame in (curve, again):
            points[name] = {r.time: r for r in frame.collect() if r.group == name}
            assert points[name].keys() == expected.keys()
            assert [points[name][t].surv for t in expected] == pytest.approx([s for s, _ in expected.values()])
            assert [points[name][t].se or 0 for t in expected] == pytest.approx([s or 0 for _, s in expected.values()])
    ends = {r["group"]: r.time for r in survival.curve_endpoints(curve).collect()}
    assert ends == {name: max(found) for name, found in points.items()}
    held = lambda name, t: points[name][max(s for s in points[name] if s <= t)].surv if t <= ends[name] else None
    difference = survival.curve_difference(curve).collect()
    assert len(difference) == len({*points["IUI"], *points["ART"]})
    for row in difference:
        pair = held("ART", row.time), held("IUI", row.time)
        assert row.diff == (None if None in pair else pytest.approx(pair[0] - pair[1]))


@pytest.mark.parametrize("name", ["km_continuous", "curve_diff_continuous", "km_risk_table"])
def test_no_window_over_a_whole_arm(spark, name):
    """Windows run inside a range of times, or over one row per range; nothing is brought together in one task."""
    plan = final_plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "SinglePartition" not in plan
    windows = [line for line in plan.split("\n") if " Window [" in line]
    assert windows
    for line in windows:
        specs = line[line.index("windowspecdefinition(") :]
        assert "part#" in specs or "_ends" in specs  # the ends come from one row per range


def test_balance_of_many_values(spark, parts):
    arm, _, _, weight, x, flag = continuous_people()
    found = {r.covariate: r for r in balance.balance_statistics(people_frame(spark), ("x", "flag")).collect()}
    assert [found[name].kind for name in ("prop.score", "x", "flag")] == ["distance", "contin.", "binary"]
    pooled = np.sqrt((x[arm].var(ddof=1) + x[~arm].var(ddof=1)) / 2)
    mean = lambda v, inside: np.average(v[inside], weights=weight[inside])
    assert found["x"].diff_unadjusted == pytest.approx((x[arm].mean() - x[~arm].mean()) / pooled)
    assert found["x"].diff_adjusted == pytest.approx((mean(x, arm) - mean(x, ~arm)) / pooled)
    assert found["flag"].diff_adjusted == pytest.approx(mean(flag, arm) - mean(flag, ~arm))
    assert found["x"].ratio_unadjusted == pytest.approx(x[arm].var(ddof=1) / x[~arm].var(ddof=1))
    assert found["flag"].ratio_unadjusted is None and found["prop.score"].diff_unadjusted is None

    def distance(values, weights):
        share = lambda inside, at: weights[inside & (values <= at)].sum() / weights[inside].sum()
        return max(abs(share(arm, at) - share(~arm, at)) for at in values)

    assert found["x"].ks_unadjusted == pytest.approx(distance(x, np.ones(len(x))))
    assert found["x"].ks_adjusted == pytest.approx(distance(x, weight))
    assert found["flag"].ks_unadjusted == pytest.approx(abs(flag[arm].mean() - flag[~arm].mean()))


def test_three_hundred_covariates(spark):
    """Fitted as fast as the plan is small: no expression for each pair of covariates."""
    from .test_statistics import newton_logistic

    rng = np.random.default_rng(11)
    size, n = 300, 4000
    x = np.column_stack([(rng.random((n, size - 20)) < 0.3).astype(float), rng.normal(size=(n, 20))])
    arm = rng.random(n) < 1 / (1 + np.exp(-(x[:, :10].sum(axis=1) - 3 + 0.5 * x[:, -1])))
    names = [f"c{i}" for i in range(size)]
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(IUI=np.where(arm, "IUI", "ART")))
    model = propensity.fit_propensity(rows, names)
    beta, errors, p = newton_logistic(x, arm.astype(float))
    assert [model.estimates[t] for t in ("(Intercept)", *names)] == pytest.approx(beta, abs=1e-6)
    assert [model.std_errors[t] for t in ("(Intercept)", *names)] == pytest.approx(errors, abs=1e-6)
    assert model.converged and model.steps < 12
    scored = propensity.with_model_scores(rows, model).select(F.sum("p_IUI")).first()[0]
    assert scored == pytest.approx(p.sum(), rel=1e-8)
