import pytest
from pyspark.sql import functions as F

from plumbline import columns as C
from plumbline.functions.expressions import Rejected, compile_snippet, derive
from plumbline.operators import prep, profile, split
from plumbline.plans.plan import Plan, Preparer, RuleAdvisor, difference, task_of


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 7) if i % 5 else None, ["a", "b", "c", None][i % 4], float(i) * 2 + 1, ["yes", "no"][i % 2]) for i in range(60)]
    return spark.createDataFrame(data, "id int, `x (m)` double, kind string, z double, y string")


def test_canonical_and_classes(spark):
    df = C.canonical(spark.createDataFrame([(float("nan"), 1, "a", True)], "a double, b int, c string, d boolean"))
    assert df.head()["a"] is None
    assert C.numeric(df) == ["a", "b"] and C.categorical(df) == ["c"]
    assert C.resolve("pric", ["price", "q"]) == "price" and C.resolve("zzz", ["price"]) is None


def test_casts_keep_columns_that_fail(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "3")], "a string, b string")
    out, failed = C.cast_columns(df, {"a": "int32", "b": "int32", "nope": "int8"})
    assert dict(out.dtypes) == {"a": "int", "b": "string"} and failed == {"a": 0, "b": 1}


def test_fit_equals_replay_and_leaks_nothing(rows):
    plan = Plan(onehot=["kind"], scaling="standard", scaling_columns=["x (m)", "z"], outlier_columns=["z"], derived=["df['w'] = df['z'] / df['x (m)']"])
    p = Preparer("classification", "y")
    train = rows.where("id < 40")
    a = p.fit_transform(train, plan)
    assert sorted(map(str, a.collect())) == sorted(map(str, p.transform(train).collect()))
    before = p.to_json()
    p.transform(rows.where("id >= 40")).collect()
    assert p.to_json() == before
    again = Preparer.from_json(before)
    assert sorted(map(str, again.transform(rows).collect())) == sorted(map(str, p.transform(rows).collect()))
    s = a.agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).head()
    assert abs(s["m"]) < 1e-9 and abs(s["s"] - 1) < 1e-9
    assert {"kind_a", "kind_b", "kind_c"} <= set(a.columns)
    assert a.where("`x (m)` IS NULL").count() == 0


def test_unseen_and_null_in_later_batches(spark, rows):
    later = spark.createDataFrame([(1, None, "new", None, "yes")], rows.schema)
    f = prep.fit_onehot(rows, ["kind"])
    assert [later_row for later_row in f.transform(later).drop("id", "y").head()][2:] == [0] * 4
    assert prep.fit_frequency(rows, ["kind"]).transform(later).head()["kind"] is None
    assert prep.fit_impute(rows, ["z"]).transform(later).head()["z"] == pytest.approx(60.0)
    with pytest.raises(Exception, match="unseen label"):
        prep.fit_label_encode(rows, "y").transform(spark.createDataFrame([("maybe",)], "y string")).collect()


def test_exact_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (10.0, "a"), (None, None)], "a double, b string")
    assert prep.fit_impute(df, ["a"], "median").params["values"]["a"] == 2.5
    assert prep.fit_impute_categorical(df, ["b"]).params["values"]["b"] == "a"
    assert prep.fit_scale(df, ["a"], "robust").params["centers"]["a"] == [2.5, 3.0]


def test_frequencies_sum_to_one_and_minmax_bounds(rows):
    f = prep.fit_frequency(rows.where("kind IS NOT NULL"), ["kind"]).params["values"]["kind"]
    assert sum(f.values()) == pytest.approx(1)
    m = prep.fit_scale(rows, ["z"], "minmax").transform(rows).agg(F.min("z").alias("a"), F.max("z").alias("b")).head()
    assert (m["a"], m["b"]) == (0, 1)


def test_collapsed_bins(spark):
    df = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "a double")
    got = {r["a"] for r in prep.fit_bins(df, ["a"], 5).transform(df).collect()}
    assert got == {"a_bin_0"}


def test_yeo_johnson_symmetric_data_has_power_one(spark):
    df = spark.range(2001).select(((F.col("id") - 1000) / 100).alias("v"))
    assert prep.fit_yeo_johnson(df, ["v"]).params["powers"]["v"] == pytest.approx(1.0, abs=0.02)


def test_bounds_methods(rows):
    for m in ("iqr", "gaussian", "mad", "quantiles"):
        lo, hi = profile.bounds(rows, ["z"], method=m)["z"]
        assert lo < hi
    with pytest.raises(ValueError):
        profile.bounds(rows, ["z"], method="clip")


def test_duplicates_and_constants(spark):
    df = spark.range(50).select("id", F.col("id").alias("same"), F.lit(1).alias("one"), (F.col("id") * 3).alias("tripled"))
    assert prep.duplicate_pairs(df) == [("id", "same")]
    assert prep.fit_drop_constant(df).params["columns"] == ["one"]
    assert prep.fit_drop_correlated(df, ["id", "same", "tripled"]).params["columns"] == ["same", "tripled"]


def test_snippets(rows):
    with pytest.raises(Rejected):
        compile_snippet("df['a'] = __import__('os').system('x')", rows)
    with pytest.raises(Rejected):
        compile_snippet("import os", rows)
    out, skipped = derive(rows, ["df['r'] = df['z'] / (df['id'] - df['id'])", "df['n'] = df['absent'] * 2", "df['b'] = (df['z'] > 10) & (df['id'] < 50)", "df['l'] = np.log1p(df['z']) ** 2"])
    assert skipped == ["df['n'] = df['absent'] * 2"]
    assert out.where("r IS NOT NULL").count() == 0 and out.where("b").count() == 45


def test_plan_contract():
    with pytest.raises(ValueError):
        Plan.from_contract({"columns_to_drop": {}})
    d = {"columns_to_drop": {"column_list": ["id", "y"]}, "columns_to_keep": [{"column_name": "x"}], "pipeline_recommendation": {"step_3_encoding": {"onehot_columns": ["k"]}, "step_2_outliers": {"method": "clip", "columns_affected": ["x"]}}}
    p = Plan.from_contract(d)
    assert p.drop == ["id", "y"] and p.onehot == ["k"] and p.outlier_columns == [] and p.without("y").drop == ["id"]
    assert Plan.from_json(p.to_json()) == p
    assert task_of("Supervised", "Regression") == "regression"
    with pytest.raises(ValueError):
        task_of("supervised", "clustering")


def test_advisor_and_difference(rows):
    plan = RuleAdvisor().plan(rows, "classification", "y")
    assert plan.drop == ["id"] and plan.onehot == ["kind"]
    p = Preparer("classification", "y")
    out = p.fit_transform(rows, plan)
    d = difference(rows, out)
    assert "id" in d["removed"] and d["missing_after"] == 0
    assert {r["y"] for r in out.select("y").distinct().collect()} == {0, 1}
    assert {r["y"] for r in p.inverse_target(out, "y").select("y").distinct().collect()} == {"yes", "no"}


def test_association_plan(rows):
    p = Preparer("association")
    out = p.fit_transform(rows.drop("y", "id"), Plan(binning=["z"]))
    assert out.where("kind = 'missing'").count() == 15 and out.select("z").distinct().count() == 5
    assert sorted(map(str, p.transform(rows.drop("y", "id")).collect())) == sorted(map(str, out.collect()))


def test_splits(spark):
    df = spark.range(1000).withColumn("c", F.col("id") % 3)
    a, b = split.train_test(df, "id")
    assert a.count() + b.count() == 1000 and a.join(b, "id").count() == 0 and 150 < b.count() < 250
    s = split.stratified(df, "c", "id").where("is_test").groupBy("c").count().collect()
    assert {r["count"] for r in s} == {66}
    f = split.folds(df, 5, "id", "c").groupBy("c", "fold").count().collect()
    assert max(r["count"] for r in f) - min(r["count"] for r in f) <= 1


def test_profile_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None)] * 3, "a double, b string")
    r = profile.numeric_profile(df).head()
    assert r["count"] == 0 and r["mean"] is None
    assert profile.outliers(df).head()["outliers"] == 0
    assert profile.missing(df).where("percent = 100").count() == 2
    assert profile.summary(df)["rows"] == 3


@pytest.mark.parametrize("most", [2, 5_000])
def test_many_categories_go_to_a_table(spark, monkeypatch, most):
    monkeypatch.setattr(prep, "MAP_UP_TO", most)
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 7.0), (None, 9.0)], "k string, y double")
    shares = {"a": 0.4, "b": 0.2, "c": 0.2, None: None, "new": None}
    later = spark.createDataFrame([(x, 0.0) for x in shares], "k string, y double")
    f = prep.Fitted.from_json(prep.fit_frequency(df, ["k"]).to_json())
    assert ("tables" in f.params) == (most == 2)
    got = f.transform(later.withColumnRenamed("y", "z").withColumn("name", F.col("k")))
    assert got.columns == ["k", "z", "name"] and {r["name"]: r["k"] for r in got.collect()} == shares
    t = prep.fit_target_encoding(df, ["k"], "y", 0.0).transform(later.withColumn("name", F.col("k")))
    assert {r["name"]: r["k"] for r in t.collect()} == {"a": 2.0, "b": 5.0, "c": 7.0, None: None, "new": None}


def test_onehot_of_too_many_categories(spark, monkeypatch):
    monkeypatch.setattr(prep, "ONEHOT_UP_TO", 3)
    with pytest.raises(ValueError):
        prep.fit_onehot(spark.range(9).select(F.col("id").cast("string").alias("k")), ["k"])


@pytest.mark.parametrize("seed", [None, 42])
def test_ranks_by_blocks(spark, seed):
    df = spark.range(3_000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("label")).repartition(5)
    out = split.folds(df, 5, "id", "label", seed).groupBy("label", "fold").count().collect()
    assert len(out) == 20 and max(r["count"] for r in out) - min(r["count"] for r in out if r["label"] == out[0]["label"]) < 600
    per = {}
    for r in out:
        per.setdefault(r["label"], []).append(r["count"])
    assert all(max(c) - min(c) <= 1 for c in per.values())
    parts = split.stratified(df, "label", "id", 0.2, seed).groupBy("label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert all(r["t"] == int(r["n"] * 0.2) for r in parts)
