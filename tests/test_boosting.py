"""Many boosted models in one pass: against single fits, a plain booster and Spark's own."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from motley.plans import boosting as bo
from motley.plans import evaluate as ev
from motley.plans import learners as ml


def data(spark, n=600, seed=3, binary=False):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    y = np.round(3 * (x[:, 0] > 0.2) + x[:, 1] - 2 * (x[:, 2] > 0) * x[:, 3] + rng.normal(size=n) * 0.3, 2)
    if binary:
        y = (y > 1).astype(float)
    weight = rng.integers(1, 4, n).astype(float)
    rows = [(int(i % 5), [float(v) for v in a], float(b * w), float(w)) for i, (a, b, w) in enumerate(zip(x, y, weight))]
    return x, y, weight, spark.createDataFrame(rows, "group int, features array<double>, total double, weight double")


MEMBERS = [{0, 1, 2, 3}, {1, 2, 3, 4}, {0, 1, 2, 3, 4}, {2}]


def outputs(boosts, cells):
    got = boosts.predict(cells, "p").select("p").collect()
    return np.array([r["p"] for r in got])


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_equal_to_single_fits(spark, monkeypatch, loss):
    monkeypatch.setattr(bo, "ROOM", 600)  # several passes per level
    *_, cells = data(spark, binary=loss == "logistic")
    cells = cells.repartition(3).cache()
    bins = bo.Bins.fit(cells, bins=8)
    rates = [0.3, 0.1, 0.5, 0.3]
    settings = {"loss": loss, "rounds": 5, "bins": bins, "save_every": 2, "least": 1.0}
    together = bo.fit_many(cells, MEMBERS, rates, depth=3, depths=[3, 3, 2, 3], **settings)
    for m, (groups, rate, depth) in enumerate(zip(MEMBERS, rates, [3, 3, 2, 3])):
        alone = bo.fit_many(cells.where(F.col("group").isin(list(groups))), [groups], [rate], depth=depth, **settings)
        assert np.allclose(outputs(together, cells)[:, m], outputs(alone, cells)[:, 0])


def plain(x, y, w, rounds, rate, depth, bins):
    """Greedy trees on binned features by trying every split of every node."""
    codes = bins.of(x)
    scores = np.full(len(y), (y * w).sum() / w.sum())
    for _ in range(rounds):
        values = np.zeros(len(y))

        def grow(rows, level):
            g, h = (w * (scores - y))[rows], w[rows]
            best = (1e-9, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for b in range(len(bins.edges[f])):
                        left = codes[rows, f] <= b
                        if left.any() and not left.all():
                            gain = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum()
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, left)
            if best[1] is None:
                values[rows] = -g.sum() / h.sum()
            else:
                grow(rows[best[1]], level + 1)
                grow(rows[~best[1]], level + 1)

        grow(np.arange(len(y)), 0)
        scores = scores + rate * values
    return scores


def test_equal_to_a_plain_booster(spark):
    x, y, w, cells = data(spark, 300)
    bins = bo.Bins.fit(cells, bins=6)
    boosts = bo.fit_many(cells.coalesce(2), [set(range(5))], [0.3], rounds=3, depth=3, bins=bins)
    assert np.allclose(outputs(boosts, cells)[:, 0], plain(x, y, w, 3, 0.3, 3, bins))


def test_as_good_as_sparks(spark):
    x, y, w, cells = data(spark)
    boosts = bo.fit_many(cells, [set(range(5))], [0.3], rounds=15, depth=4)
    ready = cells.select(array_to_vector("features").alias("features"), (F.col("total") / F.col("weight")).alias("label"), "weight")
    theirs = GBTRegressor(maxIter=15, maxDepth=4, stepSize=0.3, weightCol="weight", seed=1).fit(ready).transform(ready)
    theirs = np.array([r.prediction for r in theirs.select("prediction").collect()])
    mine = outputs(boosts, cells)[:, 0]
    assert (w * (mine - y) ** 2).sum() < 1.3 * (w * (theirs - y) ** 2).sum()


def test_quantiles(spark):
    """A leaf takes the quantile of its residuals, so a depth of one and a rate of one give two quantiles."""
    rng = np.random.default_rng(1)
    rows = [(0, [float(i % 2)], float(rng.integers(0, 50) + 100 * (i % 2)), 1.0) for i in range(200)]
    cells = spark.createDataFrame(rows, "group int, features array<double>, total double, weight double")
    boosts = bo.fit_many(cells, [{0}, {0}], [1.0, 0.5], loss="quantile", rounds=1, depth=1, q=0.75)
    got = {r.features[0]: r.p for r in boosts.predict(cells, "p").select("features", "p").distinct().collect()}
    start = np.quantile([r[2] for r in rows], 0.75)
    for side in (0.0, 1.0):
        want = np.quantile([r[2] for r in rows if r[1][0] == side], 0.75)
        assert got[side] == pytest.approx([want, start + 0.5 * (want - start)])


def plain_quantile(x, y, w, rounds, rate, depth, bins, q):
    """Greedy trees on the pinball gradient, whose leaves take the quantile of their residuals, row by row."""
    codes = bins.of(x)
    every = lambda v: np.quantile(np.repeat(v, w.astype(int)), q)
    scores = np.full(len(y), every(y))
    out = np.zeros(0)
    for _ in range(rounds):
        values = np.zeros(len(y))

        def grow(rows, level):
            g, h = (w * np.where(y > scores, -q, 1 - q))[rows], w[rows]
            best = (1e-9 * max(g.sum() ** 2 / h.sum(), 1e-12), None)
            if level < depth:
                for f in range(x.shape[1]):
                    for b in range(len(bins.edges[f])):
                        left = codes[rows, f] <= b
                        if left.any() and not left.all():
                            gain = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum() - g.sum() ** 2 / h.sum()
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, left)
            if best[1] is None:
                values[rows] = np.quantile(np.repeat((y - scores)[rows], w[rows].astype(int)), q)
            else:
                grow(rows[best[1]], level + 1)
                grow(rows[~best[1]], level + 1)

        grow(np.arange(len(y)), 0)
        scores = scores + rate * values
        out = scores
    return out


@pytest.mark.parametrize("small", [{}, {"FEW": 0}, {"CHUNK": 50, "BLOCK": 7, "POINTS": 3, "ALL": 20, "MOST": 30},
                                   {"CHUNK": 1, "BLOCK": 1, "POINTS": 3, "ALL": 0, "MOST": 60, "FEW": 0}])
def test_quantile_rounds_equal_a_plain_booster(spark, monkeypatch, small):
    """Blocks, narrowing and sums on the driver never move a result; rows without outcome or weight teach nothing."""
    for name, value in small.items():
        monkeypatch.setattr(bo, name, value)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (400, 2)).astype(float)
    y = np.round(5 * x[:, 0] - 3 * (x[:, 1] > 1) + rng.normal(size=400) * 4, 0)  # many ties
    w, group = rng.integers(1, 4, 400).astype(float), rng.integers(0, 3, 400)
    rows = [(int(g), [float(v) for v in a], float(b), float(c)) for g, a, b, c in zip(group, x, y, w)]
    rows += [(0, [0.0, 0.0], None, 5.0), (1, [9.0, 9.0], 1e6, 0.0), (7, [1.0, 1.0], -1e6, 9.0)]
    cells = spark.createDataFrame(rows, "group int, features array<double>, total double, weight double").repartition(3)
    bins = bo.Bins([[0.0, 1.0, 2.0], [0.0, 1.0, 2.0]])
    members = [{0, 1, 2}, {0, 2}]
    rounds = 3 if small.get("CHUNK") == 1 else 6
    boosts = bo.fit_many(cells, members, [0.5, 0.3], loss="quantile", rounds=rounds, depth=2, q=0.75, bins=bins, save_every=2)
    asked = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "i int, features array<double>")
    got = {r["i"]: r["p"] for r in boosts.predict(asked, "p").collect()}
    for m, (groups, rate) in enumerate(zip(members, (0.5, 0.3))):
        mine = np.isin(group, list(groups))
        want = plain_quantile(x[mine], y[mine], w[mine], rounds, rate, 2, bins, 0.75)
        assert np.allclose([got[i][m] for i in np.flatnonzero(mine)], want)


def test_jobs_do_not_grow_with_models(spark):
    *_, cells = data(spark, 100)
    bins = bo.Bins.fit(cells, bins=4)
    tracker = spark.sparkContext.statusTracker()

    def jobs(members):
        spark.sparkContext.setJobGroup(f"boost-{len(members)}", "")
        bo.fit_many(cells, members, [0.3] * len(members), rounds=2, depth=2, bins=bins)
        return len(tracker.getJobIdsForGroup(f"boost-{len(members)}"))

    assert jobs(MEMBERS * 5) <= jobs(MEMBERS[:1]) + 2
    spark.sparkContext.setJobGroup("", "")


def test_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, None], 2.0, 1.0), (0, [2.0], 4.0, 1.0), (None, [3.0, 1.0], 9.0, 3.0), (0, None, 5.0, 1.0), (1, [1.0, 1.0], None, 1.0),
            (1, [1.0, 1.0], 1.0, 0.0), (7, [5.0, 5.0], 100.0, 1.0)]
    cells = spark.createDataFrame(rows, "group int, features array<double>, total double, weight double")
    boosts = bo.fit_many(cells, [{0}, {None, 0}, {1}, set()], [0.5] * 4, rounds=2, depth=2)
    boosts.save(spark, str(tmp_path / "model"))
    again = bo.Boosts.load(spark, str(tmp_path / "model"))
    got = outputs(again, cells)
    assert np.allclose(got, outputs(boosts, cells)) and (got[:, 2:] == 0).all() and np.isfinite(got).all()
    asked = cells.select("features", F.explode(F.array(F.lit(0), F.lit(9), F.lit(None))).alias("m"))
    found = boosts.predict(asked, "p", model="m").collect()
    assert all((r.p is None) == (r.m != 0) for r in found)
    none = bo.fit_many(cells.limit(0), [{0}], [0.5], rounds=1, depth=1)
    assert np.isfinite(outputs(none, cells)).all()
    with pytest.raises(ValueError):
        bo.fit_many(cells, [{0}], [0.1], loss="other")


def people(spark, n_tables=4, n=240):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        title = f"t{i % 6}"
        gender = int(rng.random() < 0.3 + 0.08 * (i % 6))
        rows.append((i % n_tables, i % 3, title, int(i // 7 % 4), "e", "x", gender, float(50 + 10 * (i % 6) + 5 * gender + rng.integers(0, 9))))
    vectors = spark.createDataFrame([(f"t{k}", [float(k), float(k % 2)]) for k in range(6)], "title STRING, vector ARRAY<DOUBLE>")
    return spark.createDataFrame(rows, "table_id INT, fold INT, title STRING, seniority INT, employer STRING, ethnicity STRING, "
                                       "gender INT, salary DOUBLE"), vectors


def test_gap_of_every_subset(spark):
    """The gap of a subset is the gap of its rows alone, and the sex adds about five."""
    df, vectors = people(spark)
    subsets = [[0, 1, 2, 3], [0, 2], [3]]
    table = spark.createDataFrame([(s, t, int(t in x)) for s, x in enumerate(subsets) for t in range(4)], "split_id INT, table_id INT, is_test INT")
    settings = {"n_folds": 3, "rounds": 6, "lr": 0.5, "depth": 3}
    got = {r.split_id: (r.ate, r.n_rows) for r in ml.aipw_crossfit(df, vectors, subsets=table, **settings).collect()}
    for s, tables in enumerate(subsets):
        alone = ml.aipw_crossfit(df.where(F.col("table_id").isin(tables)), vectors, **settings).first()
        assert got[s] == pytest.approx((alone.ate, alone.n_rows), rel=1e-6)
    assert got[0][0] == pytest.approx(5, abs=2) and got[0][1] == 240


def test_learned_answers_of_every_split(spark):
    df, vectors = people(spark)
    tests = [[0], [1, 2]]
    splits = spark.createDataFrame([(s, t, int(t in x)) for s, x in enumerate(tests) for t in range(4)], "split_id INT, table_id INT, is_test INT")
    for task, y in (("salary", "salary"), ("sex", "gender"), ("quantile", "salary")):
        exp = "seniority" if task == "salary" else None
        both = ev.learned_answers(df, splits, vectors, "title", exp, y, task, rounds=4, depth=2)
        keys = ["title"] + ([exp] if exp else [])
        got = {tuple(r[c] for c in ["split_id", *keys]): r.estimate for r in both.collect()}
        for s in range(2):
            one = ev.learned_answers(df, splits.where(F.col("split_id") == s), vectors, "title", exp, y, task, rounds=4, depth=2)
            want = {tuple(r[c] for c in ["split_id", *keys]): r.estimate for r in one.collect()}
            assert want == pytest.approx({k: v for k, v in got.items() if k[0] == s}) and want


def test_rates_are_judged_together(spark):
    df, vectors = people(spark)
    folds = [[0, 1], [2, 3]]
    for fit_on in ("all", "seen"):
        tuned = {r.lr: r.rmse for r in ml.tune_learning_rate(df, vectors, folds, [0.01, 0.5], fit_on=fit_on, rounds=5, depth=3).collect()}
        assert tuned[0.5] < tuned[0.01] and ml.best_rate(spark.createDataFrame(list(tuned.items()), "lr DOUBLE, rmse DOUBLE")) == 0.5
    unseen = ml.tune_learning_rate(df, vectors, folds, [0.5], fit_on="unseen", rounds=1, depth=1).first()
    assert unseen.rmse is None


def test_trees_are_walked_once_per_distinct_features(spark):
    import pyarrow as pa
    boosts = bo.Boosts(bo.Bins([[0.5]]), "squared", np.zeros(2), np.ones(2), 1,
                       [bo.Tree(np.array([[0], [0]]), np.array([[0], [0]]), np.array([[1.0, 2.0], [3.0, 4.0]]))])
    fit = bo._Fit.__new__(bo._Fit)
    fit.spark, fit.boosts, fit.done = spark, boosts, 0
    batch = pa.RecordBatch.from_pydict({"group": [0] * 6, "x": [b"\x01", b"\x00", b"\x01", b"\x01", b"\x00", b"\x01"], "total": [1.0] * 6,
                                        "weight": [1.0] * 6, "scores": [np.full(2, float(i)).tobytes() for i in range(6)]})
    x, place, *_, scores = fit._scored()(batch)
    assert x[:, 0].tolist() == [1, 0] and place.tolist() == [0, 1, 0, 0, 1, 0]
    assert scores.tolist() == [[i + (2 if r else 1), i + (4 if r else 3)] for i, r in enumerate((1, 0, 1, 1, 0, 1))]
