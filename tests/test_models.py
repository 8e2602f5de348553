"""Fitted models against what must hold at the fit, and against plain versions in numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterlight.operators import boosting, models
from quarterlight.streaming import events as stream


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 2)) * [1.0, 3.0] + [0.0, 5.0]
    y = (1.4 * x[:, 0] - 0.3 * (x[:, 1] - 5) + rng.logistic(size=400) > 1).astype(int)
    rows = [(i, float(a), float(b), 2.0, int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, same double, y int").cache(), x, y


def test_balanced_logistic_has_no_gradient_at_the_fit(two_classes):
    df, x, y = two_classes
    model = models.balanced_logistic(df, ["a", "b"], "y", reg=0.0)
    p = np.array([r.p1 for r in models.with_probabilities(model, df, ["p0", "p1"]).orderBy("id").collect()])
    weight = len(y) / (2 * np.bincount(y)[y])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    gradient = (weight * (p - y)) @ np.column_stack([np.ones(len(y)), z]) / len(y)
    assert np.abs(gradient).max() < 1e-3 and 0.1 < p.min() + 0.1 < p.max()


def test_probability_columns_equal_the_models_own(two_classes):
    df, *_ = two_classes
    model = models.balanced_logistic(df, ["a", "b", "same"], "y")
    own = {r.id: list(r.probability) for r in model.transform(df).select("id", "probability").collect()}
    for r in models.with_probabilities(model, df, ["p0", "p1"]).collect():
        assert own[r.id] == pytest.approx([r.p0, r.p1], abs=1e-9) and r.prediction == float(r.p1 > r.p0)


def test_three_class_logistic_has_no_gradient_at_the_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 2))
    y = np.array([rng.choice(3, p=np.exp(s) / np.exp(s).sum()) for s in np.column_stack([x[:, 0], x[:, 1], -x.sum(axis=1)])])
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int")
    rows = models.with_probabilities(models.balanced_logistic(df, ["a", "b"], "y", reg=0.0), df, ["p0", "p1", "p2"]).orderBy("id").collect()
    p = np.array([[r.p0, r.p1, r.p2] for r in rows])
    weight = len(y) / (3 * np.bincount(y)[y])
    gradient = np.column_stack([np.ones(len(y)), x]).T @ (weight[:, None] * (p - np.eye(3)[y])) / len(y)
    assert p.sum(axis=1) == pytest.approx(1) and np.abs(gradient).max() < 2e-3


def test_top_coefficients_and_importance(two_classes):
    df, *_ = two_classes
    model = models.balanced_logistic(df, ["a", "b", "same"], "y")
    top = models.coefficients(model, ["a", "b", "same"], 1).collect()
    assert [r.feature for r in top] == ["a", "b", "same"] and [r.sign for r in top[:2]] == ["hawkish", "dovish"] and top[2].coefficient == 0
    found = {r.feature: r.importance for r in models.permutation_importance(model, df, ["a", "b", "same"], "id").collect()}
    assert found["same"] == 0 and found["a"] > found["b"] > 0.02


def ordered_rows(spark, n=600, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2)) * [1.0, 30.0] + [0.0, 5.0]
    y = np.digitize(1.5 * x[:, 0] - 0.02 * x[:, 1] + rng.standard_normal(n), [-0.8, 0.9])
    rows = [(i, float(a), float(b), 1.0, int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, one double, y int").repartition(3)


def test_ordered_probit_is_the_joint_maximum(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    x, y, df = ordered_rows(spark)
    fit = models.ordered_probit(df, ["a", "b", "one"], "y")
    assert fit.gradient < 1e-7 and (np.diff(fit.cuts) > 0).all() and fit.beta[2] == 0
    rows = models.score_probit(fit, df, ["p0", "p1", "p2"]).collect()
    p, of = np.array([[r.p0, r.p1, r.p2] for r in rows]), np.array([r.y for r in rows])
    own = np.log(p[np.arange(len(of)), of]).sum()
    assert p.sum(axis=1) == pytest.approx(1) and (p > 0).all() and own == pytest.approx(fit.loglik, rel=1e-9)
    # numerical score and Hessian at another place
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    at = np.array([0.4, -0.3, -0.5, 0.7])
    f = lambda v: models._probit_terms(z, y, v[:2], v[2:])
    _, score, hessian = f(at)
    for i, e in enumerate(1e-5 * np.eye(4)):
        assert score[i] == pytest.approx((f(at + e)[0] - f(at - e)[0]) / 2e-5, rel=1e-5)
        assert hessian[i] == pytest.approx((f(at + e)[1] - f(at - e)[1]) / 2e-5, rel=1e-4, abs=1e-4)
    # two separate fits, with what is left for the middle class, aren't likelier
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(df)
    apart = []
    for k in (1, 2):
        one = ready.withColumn("t", (F.col("y") >= k).cast("double"))
        glm = GeneralizedLinearRegression(family="binomial", link="probit", featuresCol="v", labelCol="t", maxIter=60).fit(one)
        apart.append({r.id: r.prediction for r in glm.transform(one).collect()})
    q = np.array([[1 - apart[0][r.id], apart[0][r.id] - apart[1][r.id], apart[1][r.id]] for r in rows])
    separate = np.log(np.maximum(q[np.arange(len(of)), of], 1e-12)).sum()
    shared = models._probit_terms(z, y, fit.beta[:2], fit.cuts)[0]
    assert shared == pytest.approx(fit.loglik) and fit.loglik > separate - 0.01 * abs(separate)
    for e in 1e-2 * np.eye(4):  # a maximum
        assert max(f(np.concatenate([fit.beta[:2], fit.cuts]) + s * e)[0] for s in (-1, 1)) < fit.loglik


def test_ordered_probit_on_edges(spark):
    df = spark.createDataFrame([(float(i), int(i > 5) * 2) for i in range(12)] + [(None, 1), (3.0, None)], "a double, y int")
    fit = models.ordered_probit(df, ["a"], "y", rounds=15)  # parted without error, and an empty class
    assert fit.rows == 12 and np.isfinite(fit.loglik) and fit.loglik > -1
    p = {r.a: (r.p0, r.p2) for r in models.score_probit(fit, df.filter("y IS NOT NULL"), ["p0", "p1", "p2"]).collect()}
    assert p[0.0][0] > 0.99 and p[11.0][1] > 0.99 and None not in p and fit.cuts[0] == fit.cuts[1]


def plain_boosting(binned, y, val_binned, val_y, classes, stages, depth, rate, bins):
    """The same rule over plain arrays, node by node."""
    prior = np.log(np.bincount(y, minlength=classes) / len(y))
    m, v = np.tile(prior, (len(y), 1)), np.tile(prior, (len(val_y), 1))
    losses = []

    def soft(a):
        e = np.exp(a - a.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def grow(rows, val_rows, g, h, level, k):
        value = (classes - 1) / classes * g[rows].sum() / h[rows].sum() if len(rows) and abs(h[rows].sum()) > 1e-150 else 0.0
        best, split = 1e-12, None
        if level < depth and len(rows):
            for f in range(binned.shape[1]):
                for b in range(bins - 1):
                    left = rows[binned[rows, f] <= b]
                    right = rows[binned[rows, f] > b]
                    if len(left) and len(right):
                        gain = len(left) * len(right) / len(rows) * (g[left].mean() - g[right].mean()) ** 2
                        if gain > best * (1 + 1e-9):
                            best, split = gain, (f, b)
        if split is None:
            m[rows, k] += rate * value
            v[val_rows, k] += rate * value
            return
        f, b = split
        grow(rows[binned[rows, f] <= b], val_rows[val_binned[val_rows, f] <= b], g, h, level + 1, k)
        grow(rows[binned[rows, f] > b], val_rows[val_binned[val_rows, f] > b], g, h, level + 1, k)

    for _ in range(stages):
        p = soft(m)
        for k in range(classes):
            grow(np.arange(len(y)), np.arange(len(val_y)), (y == k) - p[:, k], p[:, k] * (1 - p[:, k]), 0, k)
        losses.append(-np.log(soft(v)[np.arange(len(val_y)), val_y]).mean())
    return losses, soft(v)


@pytest.mark.parametrize("by_task", [50_000, 100])
def test_boosting_equals_plain_arrays(spark, by_task):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (260, 3)).round(2)
    y = np.where(x[:, 2] > 0.5, 2, (x[:, 0] * x[:, 1] > 0).astype(int))
    rows = [(i, *map(float, a), int(c)) for i, (a, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows + [(900, None, 0.0, 0.0, 1), (901, 0.0, 0.0, 0.0, 7)], "id long, a double, b double, c double, y int").repartition(3)
    train, val = df.filter("id < 180 OR id >= 900"), df.filter("id >= 180 AND id < 900")
    model = boosting.boosted_softmax(train, val, ["a", "b", "c"], "y", [0, 1, 2], stages=12, bins=8, rate=0.3, least=3, cells_by_task=by_task)
    binned = model.binned(x)
    losses, p = plain_boosting(binned[:180], y[:180], binned[180:], y[180:], 3, 12, 3, 0.3, 8)
    assert model.losses == pytest.approx(losses, rel=1e-9) and len(model.stages) == 12
    lowest, best = np.inf, 0
    for i, loss in enumerate(losses):
        if i >= 2 and loss < lowest - 0.001:
            lowest, best = loss, i + 1
    assert model.best == best > 0
    model.best = 12
    got = {r.id: (r.p0, r.p1, r.p2) for r in model.score(val, ["p0", "p1", "p2"]).collect()}
    assert np.array([got[i] for i in range(180, 260)]) == pytest.approx(p, rel=1e-9)
    assert np.mean(p.argmax(axis=1) == y[180:]) > 0.8


def series(n=40, seed=2):
    rng = np.random.default_rng(seed)
    v = np.zeros((n, 2))
    for t in range(2, n):
        v[t] = [0.2 * v[t - 1, 0] + 0.7 * v[t - 2, 0] + rng.normal(), 0.5 * v[t - 1, 1] + rng.normal()]
    return v + [3, -1]


def test_rolling_var_equals_a_refit_on_each_past(spark):
    v = series()
    df = spark.createDataFrame([("x", t, float(a), float(b)) for t, (a, b) in enumerate(v)], "entity string, ts int, y double, n double")
    got = {r.ts: r.delta for r in models.rolling_var(df, ["y", "n"], "entity", "ts", least=10).collect()}
    c = v - v.mean(axis=0)
    x = np.column_stack([np.ones(len(c) - 1), c[:-1]])
    for t in range(1, len(c)):
        past = t - 1  # rows 1 .. t - 1 have a row before them
        if past < 10:
            assert got[t] is None
        else:
            beta = np.linalg.lstsq(x[:past], c[1 : past + 1, 0], rcond=None)[0]
            assert got[t] == pytest.approx(float(x[t - 1] @ beta - c[t - 1, 0]), abs=1e-6)


def plain_order(v, most):
    """statsmodels' rule in numpy: all orders on the rows with `most` before them."""
    scores = []
    for p in range(most + 1):
        x = np.column_stack([np.ones(len(v) - most), *(v[most - k : len(v) - k] for k in range(1, p + 1))])
        res = v[most:] - x @ np.linalg.lstsq(x, v[most:], rcond=None)[0]
        scores.append(np.linalg.slogdet(res.T @ res / len(res))[1] + 2 * (2 * 2 * p + 2) / len(res))
    return int(np.argmin(scores))


def test_var_orders_and_fits_equal_numpy(spark):
    made = {"x": series(120), "y": series(90, 5), "z": np.random.default_rng(3).standard_normal((80, 2)), "short": series(6)}
    df = spark.createDataFrame([(e, t, float(a), float(b)) for e, v in made.items() for t, (a, b) in enumerate(v)], "entity string, ts int, y double, n double").repartition(3)
    got = {r.entity: r.p for r in models.choose_order(df, ["y", "n"], 8, "entity", "ts").collect()}
    want = {e: plain_order(v, 8) for e, v in made.items() if len(v) > 20}
    assert got == want and want["x"] >= 2 and len(set(want.values())) > 1
    fitted = {}
    for r in models.panel_var_by_order(df, ["y", "n"], 8, "entity", "ts").collect():
        fitted.setdefault(r.entity, {})[r.ts] = (r.p, r.fit_y, r.fit_n, r.res_y)
    assert set(fitted) == set(want)
    for e, p in want.items():
        v = made[e]
        x = np.column_stack([np.ones(len(v) - p), *(v[p - k : len(v) - k] for k in range(1, p + 1))])
        fit = x @ np.linalg.lstsq(x, v[p:], rcond=None)[0]
        assert sorted(fitted[e]) == list(range(p, len(v)))
        for t, row in fitted[e].items():
            assert row[0] == p and row[1:3] == pytest.approx(tuple(fit[t - p]), abs=1e-6) and row[3] == pytest.approx(v[t, 0] - fit[t - p, 0], abs=1e-6)


def test_events_are_published_handled_and_acknowledged(spark, tmp_path):
    folder, out, check = f"{tmp_path}/bus", f"{tmp_path}/out", f"{tmp_path}/check"
    row = lambda i, kind, payload: (f"e{i}", None, kind, "2024-03-05 10:00:00", None, None, ["s"], json.dumps(payload))
    ask = {"counterfactual": {"geo": 1, "max_rounds": 2}}
    for n, rows in enumerate([[row(1, "energy_shock", {"energy_risk": 0.9}), row(2, "news", {})], [row(3, "news", ask)]]):
        stream.publish(spark.createDataFrame(rows, stream.RAW), folder)
        source = stream.normalize(stream.file_source(spark, folder, done="delete"))
        stream.run_available(source, stream.archive(out), check)
        assert spark.read.parquet(out).count() == 2 + n
    stored = spark.read.parquet(out)
    assert sorted(r.event_id for r in stored.collect()) == ["e1", "e2", "e3"] and stored.select("run").distinct().count() == 3

    def run(quarter, overrides, rounds):
        if "geo" in overrides:
            raise RuntimeError("no run for geo")
        return {"quarter": quarter, "rounds": rounds, **overrides}

    requests = stream.counterfactual_requests(stored, ["energy_risk", "geo"])
    got = {r.event_id: r for r in stream.run_counterfactuals(requests, run).collect()}
    assert set(got) == {"e1", "e3"} and got["e1"].status == "completed" and json.loads(got["e1"].result) == {"quarter": "2024Q1", "rounds": 3, "energy_risk": "0.9"}
    assert got["e3"].status == "failed" and got["e3"].error == "RuntimeError: no run for geo" and got["e3"].result is None
