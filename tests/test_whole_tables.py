"""Queries and operators use every row of their tables."""

import random
from datetime import datetime

import pytest

import __spark_entry__ as entry
from plumbline.catalog import learning
from plumbline.operators import metrics, models, neighbours

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("label", ["number", "class"])
def test_models_get_all_of_lineitem(spark, label):
    rows = learning._signal(spark, DATA, label)
    n = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert rows.where("l_orderkey % 50 <> 0").count() + rows.where("l_orderkey % 50 = 0").count() == n


@pytest.mark.parametrize("k", [1, 3, 7])
def test_neighbours_at_equal_points(spark, k):
    r = random.Random(4)
    rows = [(float(r.randrange(4)), float(r.randrange(3)), float(i)) for i in range(120)]
    df = models.assemble(spark.createDataFrame(rows, "a double, b double, y double").coalesce(1), ["a", "b"], "y", ["a", "b"])
    m = models.KNNRegressor(k).fit(df)
    ids = {x["label"]: x["id"] for x in m.fitted.collect()}
    for x in m.predict(df.select("a", "b", "features").distinct()).collect():
        near = sorted(rows, key=lambda p: ((p[0] - x["a"]) ** 2 + (p[1] - x["b"]) ** 2, ids[p[2]]))[:k]
        assert x["prediction"] == pytest.approx(sum(p[2] for p in near) / k)


@pytest.mark.parametrize(("seed", "many", "spread"), [(8, 200, 60), (9, 300, 500), (10, 400, 90)])
def test_density_queries_take_all_events(spark, tmp_path, seed, many, spread):
    r = random.Random(seed)
    rows = [(i, datetime(2024, 1, 1, r.randrange(24)), i % 60, r.uniform(0, spread)) for i in range(many)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    near = {i: {j for j, u, _, w in rows if (v - w) ** 2 + (t.hour - u.hour) ** 2 <= 4} for i, t, _, v in rows}
    core = {i for i in near if len(near[i]) >= 4}
    root: dict[int, int] = {}
    for i in sorted(core):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += near[j] & core
    number = {v: n for n, v in enumerate(sorted(set(root.values())))}
    want = {i: (i in core, number[root[i]] if i in core else min((number[root[j]] for j in near[i] & core), default=-1)) for i in near}
    known = entry.queries()
    assert {tuple(x) for x in known["range_join"](spark, str(tmp_path)).collect()} == {(i, j) for i in near for j in near[i]}
    assert {x[0] for x in known["dbscan_core"](spark, str(tmp_path)).collect()} == core
    assert {x["id"]: (x["is_core"], x["cluster"]) for x in known["dbscan_labels"](spark, str(tmp_path)).collect()} == want


def brute_silhouette(pts):
    import numpy as np

    v, labels = np.array([p[1] for p in pts], dtype=float), np.array([p[2] for p in pts])
    total = 0.0
    for i in range(len(pts)):
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        mean = {c: d[labels == c].sum() / ((labels == c).sum() - (c == labels[i])) for c in set(labels.tolist())}
        a, b = mean[labels[i]], min(x for c, x in mean.items() if c != labels[i])
        total += (b - a) / max(a, b)
    return total / len(pts)


def test_silhouette_of_more_rows_than_one_block(spark):
    r = random.Random(6)
    pts = [(i, [r.random(), r.random()], i % 3) for i in range(5_200)]
    df = spark.createDataFrame(pts, "id int, v array<double>, c int")
    assert metrics.silhouette(df, "id", "v", "c").head()[0] == pytest.approx(brute_silhouette(pts))


def test_silhouette_takes_all_embeddings(spark):
    pts = [tuple(x) for x in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert len(pts) > 300
    assert entry.queries()["silhouette"](spark, DATA).head()[0] == pytest.approx(brute_silhouette(pts), abs=2e-6)


@pytest.mark.parametrize("broadcast", [20_000, 10])
def test_kernels_of_all_pairs(spark, monkeypatch, broadcast):
    import numpy as np

    monkeypatch.setattr(neighbours, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 120)
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, v = [x[0] for x in e], np.array([x[1] for x in e], dtype=float)
    dots = v @ v.T
    squares = (v * v).sum(1)
    rbf = np.exp(-0.5 * (squares[:, None] + squares[None, :] - 2 * dots))
    place = {x: n for n, x in enumerate(ids)}
    got = entry.queries()["kernels"](spark, DATA).collect()
    assert len(got) == len({(x["a"], x["b"]) for x in got}) == len(e) * (len(e) - 1) // 2
    for x in got:
        i, j = place[x["a"]], place[x["b"]]
        assert x["a"] < x["b"] and (x["rbf"], x["poly"], x["sigmoid"]) == pytest.approx((rbf[i, j], (0.5 * dots[i, j] + 1) ** 3, np.tanh(0.5 * dots[i, j])), abs=2e-6)


@pytest.mark.parametrize(("name", "value"), [("BROADCAST_QUERIES", 5), ("BROADCAST_BYTES", 100)])
def test_neighbours_in_blocks(spark, monkeypatch, name, value):
    r = random.Random(11)
    rows = [(i, [float(r.randrange(9)), float(r.randrange(9))], i % 3) for i in range(90)] + [(7, [float(i), 0.0], 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    near = lambda: sorted(tuple(x) for x in neighbours.nearest(df, df.where("id % 20 = 0"), 4, "id", "v", "manhattan", "label", exclude_self=True).collect())
    whole = near()
    monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 2)
    assert len(whole) == 5 * 4
    key = lambda x: (x[0], x[2], x[1])
    assert [key(x) for x in near()] == [key(x) for x in whole]
