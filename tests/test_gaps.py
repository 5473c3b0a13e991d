"""Gap estimators and fuzzy joins against brute force and known effects."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motley.functions import hashing
from motley.functions.vectors import reverse_embedding
from motley.operators import lookups as look
from motley.operators import sampling
from motley.operators import vector_join as vec
from motley.operators.aggregates import cells
from motley.plans import evaluate as ev
from motley.plans import gap
from motley.plans import learners as ml

T = 0.5


def fixture(n=400, titles=12, dim=6, seed=0, effect=None):
    rng = np.random.RandomState(seed)
    base = rng.normal(size=(titles, dim))
    base[titles // 2:] = base[: titles - titles // 2] + 0.4 * rng.normal(size=(titles - titles // 2, dim))
    people = pd.DataFrame({
        "row_id": np.arange(n), "table_id": rng.randint(0, 6, n),
        "title": [f"t{i}" for i in rng.randint(0, titles, n)], "seniority": rng.randint(0, 5, n),
        "employer": rng.choice(["a", "b"], n), "ethnicity": rng.choice(["x", "y"], n), "gender": rng.randint(0, 2, n),
    })
    people["salary"] = 1000.0 * people["seniority"] + 100.0 * people["title"].str[1:].astype(int) + (
        rng.randint(0, 50, n) if effect is None else effect * people["gender"])
    return people, {f"t{i}": v for i, v in enumerate(base)}


def load(spark, people, vectors):
    rows = spark.createDataFrame(people)
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "title STRING, vector ARRAY<DOUBLE>")
    return rows, table


def similar(table, t=T, **options):
    return vec.similar_pairs(table, "title", "vector", t, **options)


def cosine(a, b):
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


@pytest.mark.parametrize("t", [0.2, 0.8])
def test_similar_pairs_is_exact(spark, t):
    rng = np.random.RandomState(5)
    points = {f"p{i}": v for i, v in enumerate(np.vstack([rng.normal(size=(150, 4)), np.ones((40, 4)) + 0.01 * rng.normal(size=(40, 4))]))}
    _, table = load(spark, pd.DataFrame({"x": [1]}), points)
    want = {(a, b) for a in points for b in points if cosine(points[a], points[b]) > t}
    for options in ({}, {"block_rows": 16, "cell_rows": 10, "lead": 3}):
        got = similar(table, t, **options).collect()
        assert {(r["title"], r["other"]) for r in got} == want and len(got) == len(want)


def opposite_by_hand(people, vectors, t):
    both = people.groupby(gap.COVARIATES)
    table = [(k, len(g), g) for k, g in both]
    total, weight = 0.0, 0
    for k, n, g in table:
        men, women = g[g.gender == 1].salary, g[g.gender == 0].salary
        if len(men) and len(women):
            total, weight = total + n * (men.mean() - women.mean()), weight + n
            continue
        sex = int(len(men) > 0)
        match = [h.salary.mean() for q, _, h in table if q[1:] == k[1:] and (h.gender == 1 - sex).all()
                 and cosine(vectors[k[0]], vectors[q[0]]) > t]
        if match:
            d = g.salary.mean() - np.mean(match)
            total, weight = total + n * (d if sex else -d), weight + n
    return total / weight, weight / len(people)


def test_fuzzy_opposite_gap(spark):
    people, vectors = fixture()
    rows, table = load(spark, people, vectors)
    got = gap.fuzzy_opposite_gap(rows, similar(table), T).first()
    assert (got["ate"], got["share_kept"]) == pytest.approx(opposite_by_hand(people, vectors, T))


def aipw_by_hand(people, vectors, t):
    table = [(k, g) for k, g in people.groupby(gap.COVARIATES)]
    total = 0.0
    for k, g in table:
        w, p, m1, m0 = [], [], [], []
        for q, h in table:
            s = max((cosine(vectors[k[0]], vectors[q[0]]) - t) / (1 - t), 0)
            if s and q[2:] == k[2:] and abs(q[1] - k[1]) <= 2:
                w.append(s)
                p.append(h.gender.mean())
                m1.append(h[h.gender == 1].salary.mean())
                m0.append(h[h.gender == 0].salary.mean())
        w, p, m1, m0 = map(np.array, (w, p, m1, m0))
        e = (w * p).sum() / w.sum()
        y, g1 = g.salary.to_numpy(), g.gender.to_numpy()
        if np.isnan(m1).all():
            total += -y.sum()
        elif np.isnan(m0).all():
            total += y.sum()
        else:
            mu1, mu0 = [(w * np.nan_to_num(m)).sum() / w[~np.isnan(m)].sum() for m in (m1, m0)]
            total += (g1 * (y - mu1) / e - (1 - g1) * (y - mu0) / (1 - e) + mu1 - mu0).sum()
    return total / len(people)


def test_fuzzy_aipw(spark):
    people, vectors = fixture(n=120)
    rows, table = load(spark, people, vectors)
    assert gap.fuzzy_aipw(rows, similar(table), T).first()["ate"] == pytest.approx(aipw_by_hand(people, vectors, T))


def test_reversing_all_vectors_changes_nothing(spark):
    people, vectors = fixture()
    rows, table = load(spark, people, vectors)
    turned = table.withColumn("vector", reverse_embedding(F.col("vector"), F.lit(1), [1]))
    one, two = (gap.fuzzy_aipw(rows, similar(t), T).first()["ate"] for t in (table, turned))
    assert one == pytest.approx(two, abs=1e-9)


@pytest.mark.parametrize("dismiss", [True, False])
def test_exact_gap(spark, dismiss):
    people, vectors = fixture(effect=70.0)
    got = gap.exact_matching_gap(load(spark, people, vectors)[0], dismiss=dismiss).first()
    groups = [g for _, g in people.groupby(gap.COVARIATES)]
    kept = [g for g in groups if g.gender.nunique() == 2] if dismiss else groups
    want = sum(len(g) * (np.nan_to_num(g[g.gender == 1].salary.mean()) - np.nan_to_num(g[g.gender == 0].salary.mean()))
               for g in kept) / sum(map(len, kept))
    assert got["ate"] == pytest.approx(want)
    if dismiss:
        assert got["ate"] == pytest.approx(70.0)


def test_kernel_estimate_by_hand(spark):
    people, vectors = fixture()
    rows, table = load(spark, people, vectors)
    train, asked = rows.where("table_id < 3"), rows.where("table_id >= 3").select("title", "seniority").distinct()
    grains = look.grain_estimates(train, "title", "seniority", "salary")
    got = {(r["title"], r["seniority"]): r["estimate"]
           for r in look.kernel_join(asked, grains, similar(table), T, "title", "seniority").collect()}
    old = people[people.table_id < 3]
    means = old.groupby(["title", "seniority"]).salary.agg(["mean", "size"]).reset_index()
    for (title, exp), value in got.items():
        near = means[means.seniority == exp]
        w = np.array([max((cosine(vectors[title], vectors[o]) - T) / (1 - T), 0) for o in near.title]) * near["size"].to_numpy()
        want = (w * near["mean"]).sum() / w.sum() if w.sum() else old[old.seniority == exp].salary.mean()
        assert value == pytest.approx(want)


def test_down_sampling_is_exact_and_total_at_rate_one(spark):
    people, vectors = fixture()
    rows = load(spark, people, vectors)[0]
    for rate in (0.0, 0.37, 1.0):
        kept = sampling.stratified_downsample(
            rows, ["table_id", "gender"], "row_id", F.when(F.col("gender") == 0, rate).otherwise(0.0),
            hashing.mixed_hash(F.col("row_id"), 3)).toPandas()
        for (_, g), group in people.groupby(["table_id", "gender"]):
            left = kept[(kept.table_id == _) & (kept.gender == g)]
            assert len(left) == len(group) - (int(len(group) * rate) if g == 0 else 0)
    assert set(kept.gender) == {1}


def test_sweep_runs_apart(spark):
    people, vectors = fixture(effect=30.0)
    rows = load(spark, people, vectors)[0]
    runs = spark.createDataFrame([(r, rate, t, int(t < 3)) for r, rate in enumerate((0.0, 0.5)) for t in range(6)],
                                 "run_id INT, rate DOUBLE, table_id INT, men INT")
    out = ev.sensitivity_sweep(rows, runs, "row_id", hashing.mixed_hash(F.col("row_id"), F.col("run_id")),
                               lambda cells, by: gap.gap_of_cells(cells, by=by)).orderBy("run_id").collect()
    assert out[0]["n_rows"] == len(people) > out[1]["n_rows"]
    assert all(r["ate"] == pytest.approx(30.0) for r in out)


def test_learned_gap_recovers_a_constant_effect(spark):
    people, vectors = fixture(n=3000, effect=500.0)
    rows, table = load(spark, people, vectors)
    assert ml.aipw(rows, table, rounds=10, depth=4).first()["ate"] == pytest.approx(500.0, rel=0.1)


def test_cells_keep_every_row(spark):
    people, vectors = fixture()
    assert cells(load(spark, people, vectors)[0], gap.COVARIATES).agg(F.sum("n")).first()[0] == len(people)


def test_cells_prune_clustered_vectors(spark):
    """Vectors in clusters: exact, and fewer than a fifth of the pairs are scored."""
    rng = np.random.RandomState(8)
    centres = rng.normal(size=(40, 48))
    x = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.15, size=(2_000, 48))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "title long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.title, r.other) for r in vec.similar_pairs(rows, "title", "vector", 0.8, block_rows=500, cell_rows=40).collect()}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(u @ u.T > 0.8))))
    unit = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "title long, _u array<double>")
    cells, pivots = vec._in_cells(vec._leading(unit, "title", 32), "title", 50)
    stats = cells.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_away").alias("radius"), F.min("_rest").alias("lo"),
                                       F.max("_rest").alias("hi"))
    sizes = {r["_cell"]: r["n"] for r in stats.collect()}
    scored = sum(sizes[r.a] * sizes[r.b] * (1 if r.a == r.b else 2) for r in vec._cell_pairs(stats, pivots, 0.8, 500).collect())
    assert scored < 0.2 * 2_000**2
