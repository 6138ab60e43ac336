import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import balance, propensity, survival

COVARIATES = ("a", "b", "c")


def people(seed=3, n=600):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, 3)) < (0.2, 0.5, 0.35)).astype(float)
    p = 1 / (1 + np.exp(-(-0.4 + x @ np.array([0.9, -0.6, 0.2]))))
    arm = rng.random(n) < p
    time = rng.integers(0, 60, n).astype(float)
    event = (rng.random(n) < 0.5) & (time > 0)
    return x, arm, time, event


def frame(spark, x, arm, time, event):
    data = [
        (i, *map(float, row), "IUI" if arm[i] else "ART", float(time[i]), bool(event[i])) for i, row in enumerate(x)
    ]
    return spark.createDataFrame(
        data, "person_id long, a double, b double, c double, IUI string, time_to_delivery double, event_delivery boolean"
    )


def newton_logistic(x, y):
    """Plain Newton iterations on single rows: coefficients and standard errors, intercept first."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        hessian = design.T @ (design * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(hessian, design.T @ (y - p))
    return beta, np.sqrt(np.diag(np.linalg.inv(hessian))), p


def kaplan_meier(time, event, weight):
    """Curve and standard error at time 0, event times and the last time, by loops."""
    surv, var, out = 1.0, 0.0, {}
    for t in sorted({0.0, *time}):
        risk, here = time >= t, (time == t) & event
        y, d = weight[risk].sum(), weight[here].sum()
        m = y * y / (weight[risk] ** 2).sum()
        if y - d <= 1e-9 * y:
            surv = 0.0
        else:
            surv, var = surv * (1 - d / y), var + d / (m * (y - d))
        if t == 0 or here.any() or t == max(time):
            out[t] = (surv, surv * np.sqrt(var) if surv > 0 else None)
    return out


def test_grouped_fit_equals_row_level_newton(spark):
    x, arm, time, event = people()
    model = propensity.fit_propensity(frame(spark, x, arm, time, event), COVARIATES)
    beta, errors, p = newton_logistic(x, arm.astype(float))
    terms = ("(Intercept)", *COVARIATES)
    assert [model.estimates[t] for t in terms] == pytest.approx(beta, abs=1e-6)
    assert [model.std_errors[t] for t in terms] == pytest.approx(errors, abs=1e-6)
    deviance = -2 * np.log(np.where(arm, p, 1 - p)).sum()
    assert model.statistics["residual_deviance"] == pytest.approx(deviance, rel=1e-8)
    assert model.statistics["aic"] == pytest.approx(deviance + 8, rel=1e-8)
    scored = propensity.with_model_scores(frame(spark, x, arm, time, event), model).orderBy("person_id")
    assert [r.p_IUI for r in scored.collect()] == pytest.approx(list(p), abs=1e-7)
    assert {r.term for r in model.table(spark).collect()} == set(terms)


def test_cells_and_rows_give_the_same_model(spark):
    rows = frame(spark, *people())
    cells = rows.groupBy(*COVARIATES, "IUI", "time_to_delivery", "event_delivery").agg(F.count("*").alias("n"))
    by_rows = propensity.fit_propensity(rows, COVARIATES)
    by_cells = propensity.fit_propensity(cells, COVARIATES, freq="n")
    for term, value in by_rows.estimates.items():
        assert by_cells.estimates[term] == pytest.approx(value, abs=1e-8)


def test_three_weight_vectors_agree(spark):
    """Weights by hand, from single rows and from cells."""
    x, arm, time, event = people()
    rows = frame(spark, x, arm, time, event)
    cells = rows.groupBy(*COVARIATES, "IUI", "time_to_delivery", "event_delivery").agg(F.count("*").alias("n"))
    _, _, p = newton_logistic(x, arm.astype(float))
    by_hand = np.where(arm, 1 / p, 1 / (1 - p))
    for model in (
        propensity.fit_propensity(rows, COVARIATES),
        propensity.fit_propensity(cells, COVARIATES, freq="n"),
    ):
        weighted = propensity.with_weights(propensity.with_model_scores(rows, model)).orderBy("person_id").collect()
        assert np.abs(by_hand - [r.ip_weight for r in weighted]).max() < 1e-6


def test_covariate_without_variation_has_no_coefficient(spark):
    x, arm, time, event = people()
    x[:, 1] = 0
    model = propensity.fit_propensity(frame(spark, x, arm, time, event), COVARIATES)
    assert model.estimates["b"] is None
    beta, _, _ = newton_logistic(x[:, [0, 2]], arm.astype(float))
    assert model.estimates["c"] == pytest.approx(beta[2], abs=1e-6)


def fitted(spark, columns, arm, names):
    data = [(*map(float, row), "IUI" if a else "ART") for row, a in zip(columns, arm)]
    rows = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names) + ", IUI string")
    return rows, propensity.fit_propensity(rows, names)


def test_any_numeric_covariates(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(40, 12, 500), rng.integers(0, 9, 500), rng.random(500) < 0.3])
    arm = rng.random(500) < 1 / (1 + np.exp(-(0.05 * (x[:, 0] - 40) - 0.2 * x[:, 1])))
    _, model = fitted(spark, x, arm, ("age", "visits", "flag"))
    beta, errors, _ = newton_logistic(x, arm.astype(float))
    terms = ("(Intercept)", "age", "visits", "flag")
    assert [model.estimates[t] for t in terms] == pytest.approx(beta, abs=1e-7)
    assert [model.std_errors[t] for t in terms] == pytest.approx(errors, abs=1e-7)
    assert model.converged


def test_many_covariates(spark):
    rng = np.random.default_rng(6)
    x = (rng.random((800, 15)) < 0.5).astype(float)
    arm = rng.random(800) < 0.4
    names = tuple(f"c{i}" for i in range(15))
    _, model = fitted(spark, x, arm, names)
    beta, _, _ = newton_logistic(x, arm.astype(float))
    assert [model.estimates[t] for t in ("(Intercept)", *names)] == pytest.approx(beta, abs=1e-7)


def test_aliased_columns_have_no_coefficient(spark):
    """Equal columns, a complement, a sum and constants: the earlier ones are fitted, as if the others were not there."""
    x, arm, _, _ = people()
    more = np.column_stack([x, x[:, 0], 1 - x[:, 1], x[:, 0] + 2 * x[:, 2], np.full(len(x), 3.0)])
    _, model = fitted(spark, more, arm, (*COVARIATES, "twin", "complement", "total", "constant"))
    beta, errors, _ = newton_logistic(x, arm.astype(float))
    assert [model.estimates[t] for t in ("(Intercept)", *COVARIATES)] == pytest.approx(beta, abs=1e-7)
    assert [model.std_errors[t] for t in COVARIATES] == pytest.approx(errors[1:], abs=1e-7)
    assert all(model.estimates[t] is None and model.std_errors[t] is None for t in ("twin", "complement", "total", "constant"))


def test_no_varying_column_leaves_the_intercept(spark):
    arm = [True] * 30 + [False] * 70
    _, model = fitted(spark, np.zeros((100, 2)), arm, ("a", "b"))
    assert model.estimates == {"a": None, "b": None, "(Intercept)": pytest.approx(np.log(0.3 / 0.7))}
    assert model.statistics["residual_deviance"] == pytest.approx(model.statistics["null_deviance"])


def test_one_arm_is_an_error(spark):
    with pytest.raises(ValueError, match="both arms"):
        fitted(spark, np.zeros((10, 1)), [True] * 10, ("a",))


def test_separated_fit_is_reported(spark):
    x = np.repeat([[0.0], [1.0]], 40, axis=0)
    rows, model = fitted(spark, x, x[:, 0] == 1, ("a",))
    report = {r["group"]: r for r in model.positivity(propensity.with_model_scores(rows, model)).collect()}
    assert report["IUI"].n_near_one == 40 and report["ART"].n_near_zero == 40
    assert np.isfinite(list(model.statistics.values())).all()


def test_curve_equals_brute_force(spark):
    x, arm, time, event = people()
    model = propensity.fit_propensity(frame(spark, x, arm, time, event), COVARIATES)
    weighted = propensity.with_weights(propensity.with_model_scores(frame(spark, x, arm, time, event), model))
    curve = survival.weighted_km(survival.risk_table(weighted, weight="ip_weight")).collect()
    _, _, p = newton_logistic(x, arm.astype(float))
    weights = np.where(arm, 1 / p, 1 / (1 - p))
    for name, inside in (("IUI", arm), ("ART", ~arm)):
        expected = kaplan_meier(time[inside], event[inside], weights[inside])
        actual = {r.time: (r.surv, r.se) for r in curve if r.group == name}
        assert actual.keys() == expected.keys()
        for t, (surv, se) in expected.items():
            assert actual[t][0] == pytest.approx(surv, abs=1e-6)
            assert actual[t][1] == (None if se is None else pytest.approx(se, abs=1e-6))
        ordered = [actual[t][0] for t in sorted(actual)]
        assert all(1 >= a >= b >= 0 for a, b in zip(ordered, ordered[1:]))


def test_weights_of_one_give_the_plain_curve(spark):
    data = [("IUI", 1.0, True), ("IUI", 2.0, False), ("IUI", 3.0, True), ("IUI", 4.0, True)]
    rows = spark.createDataFrame(data, "IUI string, time_to_delivery double, event_delivery boolean")
    curve = survival.weighted_km(survival.risk_table(rows)).orderBy("time").collect()
    assert [(r.time, round(r.surv, 9)) for r in curve] == [(0.0, 1.0), (1.0, 0.75), (3.0, 0.375), (4.0, 0.0)]
    assert curve[-1].se is None and curve[-1].ci_lower is None
    assert curve[0].se == 0.0


def test_counts_stand_for_rows(spark):
    x, arm, time, event = people()
    rows = frame(spark, x, arm, time, event).withColumn("w", 1 + F.col("a"))
    counted = rows.groupBy("IUI", "time_to_delivery", "event_delivery", "w").agg(F.count("*").alias("n"))
    a = survival.weighted_km(survival.risk_table(rows, weight="w")).orderBy("group", "time").collect()
    b = survival.weighted_km(survival.risk_table(counted, weight="w", freq="n")).orderBy("group", "time").collect()
    assert [r.surv for r in a] == pytest.approx([r.surv for r in b])
    assert [r.se or 0 for r in a] == pytest.approx([r.se or 0 for r in b])


def test_difference_holds_values_and_stops_with_the_shorter_curve(spark):
    curve = spark.createDataFrame(
        [("ART", 0.0, 1.0, 0.0), ("ART", 2.0, 0.8, 0.1), ("ART", 5.0, 0.5, 0.2)]
        + [("IUI", 0.0, 1.0, 0.0), ("IUI", 3.0, 0.6, 0.1)],
        "group string, time double, surv double, se double",
    )
    result = survival.curve_difference(curve).orderBy("time").collect()
    assert [(r.time, None if r.diff is None else round(r.diff, 9)) for r in result] == [
        (0.0, 0.0),
        (2.0, -0.2),
        (3.0, 0.2),
        (5.0, None),
    ]
    assert result[2].se == pytest.approx(np.sqrt(0.02))
    assert result[0].p_value is None


