import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics, models, neighbours
from plumbline.plans import automl
from plumbline.sources import tables
from plumbline.streaming import replay


@pytest.fixture(scope="module")
def blobs(spark):
    r = random.Random(3)
    data = [(i, c * 5 + r.gauss(0, 0.6), -c * 4 + r.gauss(0, 0.6), ["red", "green", "blue"][c], c * 2.0 + 1) for i in range(150) for c in [i % 3]]
    return spark.createDataFrame(data, "id int, a double, b double, name string, v double").repartition(2, "id").persist()


def test_exact_line(spark):
    m = models.LinearRegression().fit(models.assemble(spark.createDataFrame([(float(x), 2.0 * x) for x in range(1, 5)], "x double, y double"), ["x"], "y"))
    assert m.coef_[0] == pytest.approx(2) and m.intercept_ == pytest.approx(0, abs=1e-9)


def test_noise_free_plane(spark):
    r = random.Random(1)
    rows = [(*x, 1.5 * x[0] - 2 * x[1] + 3 * x[2] + 4) for x in ([r.gauss(0, 1) for _ in range(3)] for _ in range(100))]
    df = models.assemble(spark.createDataFrame(rows, "a double, b double, c double, y double"), ["a", "b", "c"], "y")
    m = models.LinearRegression().fit(df)
    assert m.coef_ == pytest.approx([1.5, -2, 3]) and m.intercept_ == pytest.approx(4) and m.score(df) == pytest.approx(1)
    assert m.residuals(df).agg(F.max(F.abs("residual"))).head()[0] < 1e-6


CLASSIFIERS = [("LogisticRegression", {"epochs": 30}), ("DecisionTreeClassifier", {"max_depth": 4}), ("RandomForestClassifier", {"n_estimators": 5, "max_depth": 4}), ("BaggingClassifier", {"n_estimators": 3}), ("SVMClassifier", {"kernel": "linear", "epochs": 20}), ("SVMClassifier", {"kernel": "rbf", "epochs": 20}), ("KNNClassifier", {})]


@pytest.mark.parametrize(("name", "params"), CLASSIFIERS)
def test_classifiers_learn_save_load(spark, blobs, tmp_path, name, params):
    df = models.assemble(blobs, ["a", "b"], "name", ["id"])
    m = models.REGISTRY[name](**params)
    with pytest.raises(RuntimeError):
        m.predict(df)
    m.fit(df)
    assert m.score(df) > 0.9
    m.save(str(tmp_path / "m"), spark)
    again = models.load(str(tmp_path / "m"), spark)
    assert again.get_params() == m.get_params()
    assert sorted((r["id"], r["prediction"]) for r in again.predict(df).collect()) == sorted((r["id"], r["prediction"]) for r in m.predict(df).collect())


@pytest.mark.parametrize(("name", "params"), [("Ridge", {"alpha": 0.01}), ("Lasso", {"alpha": 0.01}), ("DecisionTreeRegressor", {}), ("RandomForestRegressor", {"n_estimators": 5}), ("BaggingRegressor", {"n_estimators": 3}), ("SVMRegressor", {"epochs": 30}), ("KNNRegressor", {"weights": "distance"})])
def test_regressors(spark, blobs, tmp_path, name, params):
    df = models.assemble(blobs, ["a", "b"], "v", ["id"])
    m = models.REGISTRY[name](**params).fit(df)
    assert m.score(df) > 0.8
    m.save(str(tmp_path / "m"), spark)
    assert models.load(str(tmp_path / "m"), spark).score(df) == pytest.approx(m.score(df))


def test_clusters(spark, blobs, tmp_path):
    df = models.assemble(blobs, ["a", "b"], keep=["id", "name"])
    k = models.KMeans(3, n_init=3).fit(df)
    assert k.predict(df).select("name", "prediction").distinct().count() == 3 and k.score(df) > 0.8
    d = models.DBSCAN(1.5, 5).fit(df)
    assert d.n_clusters_ == 3 and d.predict(df).where("prediction >= 0").select("name", "prediction").distinct().count() == 3
    d.save(str(tmp_path / "d"), spark)
    assert models.load(str(tmp_path / "d"), spark).predict(df).where("prediction >= 0").count() == d.predict(df).where("prediction >= 0").count()


def test_dbscan_against_brute_force(spark):
    r = random.Random(9)
    pts = [(i, r.uniform(0, 12), r.uniform(0, 12)) for i in range(180)]
    got = {x["id"]: (x["is_core"], x["cluster"]) for x in neighbours.dbscan(spark.createDataFrame(pts, "id int, x double, y double"), "id", ["x", "y"], 1.0, 4).collect()}
    near = {i: [j for j, u, v in pts if (u - x) ** 2 + (v - y) ** 2 <= 1.0] for i, x, y in pts}
    core = {i for i in near if len(near[i]) >= 4}
    root = {}
    for i in sorted(core):
        if i not in root:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in root:
                    root[j] = i
                    todo += [k for k in near[j] if k in core]
    number = {v: n for n, v in enumerate(sorted(set(root.values())))}
    for i in near:
        want = number[root[i]] if i in core else min((number[root[j]] for j in near[i] if j in core), default=-1)
        assert got[i] == (i in core, want)


def test_silhouette_brute(spark):
    r = random.Random(2)
    pts = [(i, [r.random(), r.random()], i % 3) for i in range(30)]
    d = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5
    total = 0
    for i, p, c in pts:
        mean = {k: [d(p, q) for j, q, e in pts if e == k and j != i] for k in range(3)}
        a, b = sum(mean[c]) / len(mean[c]), min(sum(v) / len(v) for k, v in mean.items() if k != c)
        total += (b - a) / max(a, b)
    got = metrics.silhouette(spark.createDataFrame(pts, "id int, v array<double>, c int"), "id", "v", "c").head()[0]
    assert got == pytest.approx(total / 30)


def test_nulls_raise(spark):
    with pytest.raises(Exception, match="null in a"):
        models.assemble(spark.createDataFrame([(None,), (1.0,)], "a double")).collect()


def test_parameters():
    m = models.KNNClassifier()
    assert m.set_params(n_neighbors=3).get_params() == {"n_neighbors": 3, "weights": "uniform", "metric": "euclidean"}
    with pytest.raises(ValueError):
        m.set_params(k=3)


def test_sampler_finds_good_region():
    s = automl.Sampler({"x": ("float", 0.0, 10.0), "k": ("choice", ["a", "b"])}, seed=1)
    for _ in range(60):
        p = s.suggest()
        s.tell(p, -((p["x"] - 7) ** 2) + (p["k"] == "b"))
    late = [p for _, p in s.trials[-20:]]
    assert sum(abs(p["x"] - 7) < 2.5 for p in late) > 12 and set(automl.SPACES) >= set(models.REGISTRY)


def test_end_to_end(spark, blobs, tmp_path):
    out = automl.training_pipeline(blobs.drop("v"), "id", "name", "supervised", "classification", n_trials=1, budget=60, only=["DecisionTreeClassifier", "KNNClassifier"], cv_folds=2)
    run = out["automl"]
    assert out["evaluation"]["score"] > 0.9 and run.leaderboard().count() == 2 and run.leaderboard(1).count() == 1
    run.save_best(str(tmp_path))
    assert automl.AutoML.load_model(f"{tmp_path}/{run.best}", spark).score(run.test) == pytest.approx(run.results[0].score)
    assert '"best_model"' in run.export()


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 1.0, "y")], "id int, v double, t string")
    tables.write(df, str(tmp_path / "t.csv"), "csv", "t")
    assert tables.read(spark, str(tmp_path / "t.csv")).count() == 2
    assert spark.read.csv(str(tmp_path / "t.csv_target"), header=True).columns == ["t"]
    df.write.parquet(str(tmp_path / "p.parquet"))
    assert tables.read(spark, str(tmp_path / "p.parquet")).where("v IS NULL").count() == 1
    df.limit(0).write.parquet(str(tmp_path / "e.parquet"))
    with pytest.raises(tables.EmptyTable):
        tables.read(spark, str(tmp_path / "e.parquet"))
    tables.write_report({"a": 1}, str(tmp_path / "r.json"))


def test_stream_replays_fitted_stages(spark, tmp_path):
    from plumbline.operators import prep

    df = spark.range(100).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("k"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stages = [prep.fit_scale(df, ["v"]), prep.fit_onehot(df, ["k"])]
    replay.run_available(replay.replay(replay.read_stream(spark, str(tmp_path / "in"), df.schema, 1), stages), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = replay.replay(df, stages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name,params", [("DecisionTreeRegressor", {"criterion": "mae"}), ("DecisionTreeClassifier", {"max_depth": 31}), ("DecisionTreeClassifier", {"min_samples_split": 9}), ("SVMClassifier", {"kernel": "other"})])
def test_parameters_that_are_not_offered_raise(blobs, name, params):
    with pytest.raises(ValueError):
        models.REGISTRY[name](**params).fit(blobs)


@pytest.mark.parametrize("params", [{"kernel": "sigmoid", "gamma": 0.05}, {"kernel": "poly", "degree": 2, "coef0": 1.0}, {"kernel": "poly", "degree": 5, "coef0": 1.0}])
def test_kernels_differ_and_survive_saving(spark, blobs, tmp_path, params):
    blobs = models.assemble(blobs, ["a", "b"], "name")
    m = models.SVMClassifier(epochs=5, **params).fit(blobs)
    assert len(m.fitted[0][0]) == len(m.points) <= 64
    m.save(str(tmp_path / "m"), spark)
    same = models.load(str(tmp_path / "m"), spark)
    assert same.predict(blobs).select("prediction").collect() == m.predict(blobs).select("prediction").collect()


def test_bagging_of_other_models_and_rare_classes(spark, blobs, tmp_path):
    df = models.assemble(blobs, ["a", "b"], "name", ["id"])
    m = models.BaggingClassifier(2, max_samples=0.9, base_estimator="LogisticRegression", bootstrap_features=True).fit(df)
    m.save(str(tmp_path / "m"), spark)
    again = models.load(str(tmp_path / "m"), spark)
    assert sorted(map(str, again.predict(df).select("id", "prediction").collect())) == sorted(map(str, m.predict(df).select("id", "prediction").collect()))
    rare = models.BaggingClassifier(3, max_samples=0.05, bootstrap=False).fit(df)
    assert {r[0] for r in rare.predict(df).select("prediction").distinct().collect()} <= {"red", "green", "blue"}
    with pytest.raises(ValueError):
        models.BaggingClassifier(1, base_estimator="KNNClassifier").fit(df)


def test_bisecting_clusters_and_history(spark, blobs):
    df = models.assemble(blobs, ["a", "b"], "name")
    assert models.BisectingKMeans(3).fit_predict(df).select("prediction").distinct().count() == 3
    h = models.LogisticRegression(epochs=20).fit(df).history_
    assert len(h) > 2 and h[-1] <= h[0]


def test_dbscan_cosine_against_brute_force(spark):
    r = random.Random(12)
    pts = [(i, r.gauss(0, 3), r.gauss(0, 3)) for i in range(120)] + [(200, 0.0, 0.0)]
    got = {x["id"]: (x["is_core"], x["cluster"]) for x in neighbours.dbscan(spark.createDataFrame(pts, "id long, a double, b double"), "id", ["a", "b"], 0.002, 4, "cosine").collect()}
    d = lambda p, q: 1 - (p[1] * q[1] + p[2] * q[2]) / ((p[1] ** 2 + p[2] ** 2) ** 0.5 * (q[1] ** 2 + q[2] ** 2) ** 0.5)
    there = pts[:-1]
    near = {p[0]: {q[0] for q in there if d(p, q) <= 0.002} for p in there}
    core = {i for i in near if len(near[i]) >= 4}
    root = {}
    for i in sorted(core):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += near[j] & core
    number = {v: n for n, v in enumerate(sorted(set(root.values())))}
    want = {i: (i in core, number[root[i]] if i in core else min((number[root[j]] for j in near[i] & core), default=-1)) for i in near}
    assert got == want | {200: (False, -1)}


def test_answers_are_read():
    from plumbline.plans import answers

    assert answers.parsed('<think>{"a": 1}</think> ```json\n{"b": [2]}\n```') == {"b": [2]}
    assert answers.parsed("so: {'no'}") == {} and answers.parsed(None) == {} and answers.parsed("<think>open {}") == {} and answers.parsed("[1]") == {}
    columns = [{"name": "a", "priority": "low"}, {"name": "b", "priority": "high"}, {"name": "c"}, {"name": "d", "priority": "HIGH", "keep": False}]
    assert [c["name"] for c in answers.kept_by_priority(columns, 2)] == ["b", "a"]


def test_asking_advisor_falls_back_and_results_are_written(spark, blobs, tmp_path):
    import json

    from plumbline.plans import answers

    plan = answers.AskingAdvisor(lambda prompt: "no idea").plan(blobs.select("a", "b", "name"), "classification", "name")
    assert plan == automl.RuleAdvisor().plan(blobs.select("a", "b", "name"), "classification", "name")
    df = models.assemble(blobs, ["a", "b"], "name")
    asked = []
    run = automl.AutoML.with_budget("classification", df, df, "basic", cv_folds=2, only=["DecisionTreeClassifier"], suggest=lambda m, f: asked.append(f) or {"max_depth": 2, "other": 1})
    run.n_trials = 1
    run.fit()
    assert run.results[0].params["max_depth"] == 2 and asked[0]["rows"] == 150
    run.export(str(tmp_path / "r"))
    written = json.loads(spark.read.text(str(tmp_path / "r")).head()[0])
    assert written["summary"]["failed"] == [] and "cv_low" in written["results"][0]
    run.save_best(str(tmp_path / "best"))
    facts = json.loads(spark.read.text(str(tmp_path / "best/DecisionTreeClassifier/metadata")).head()[0])
    assert facts["megabytes"] > 0 and facts["model"] == "DecisionTreeClassifier"
    assert run.formatted().columns[-3:] == ["cv_low", "cv_high", "overfit"]
