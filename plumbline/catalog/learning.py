"""Queries of models, splits, metrics and tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, rounded, table
from plumbline.functions import scalar as S
from plumbline.operators import metrics as M
from plumbline.operators import models, split
from plumbline.operators import neighbours as N
from plumbline.plans import automl

# --- splits


@query("""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 < floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders""")
def split_stratified(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return split.stratified(t, "o_orderstatus", "o_orderkey", 0.2, None)


@query("SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders")
def kfold_assign(spark, d):
    return split.folds(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 5, "o_orderkey", "o_orderstatus", None)


@query()
def split_hash(spark, d):
    a, b = split.train_test(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return a.agg(F.count("*").alias("train")).join(b.agg(F.count("*").alias("test")))


# --- neighbours

_SIDES = """q AS (SELECT vec_id AS a, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), t AS (SELECT vec_id AS b, CAST(embedding AS DOUBLE[]) AS u, label FROM embeddings)"""
_DIST = {"euclidean": "list_distance(v, u)", "manhattan": "list_sum(list_transform(list_zip(v, u), lambda z: abs(z[1] - z[2])))", "cosine": "1 - list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u)) + 1e-8)"}


def _near(spark, d, metric, k=5):
    e = table(spark, d, "embeddings")
    return N.nearest(e, e.where("vec_id % 20 = 0"), k, "vec_id", "embedding", metric, "label", exclude_self=True)


def _knn_sql(metric: str, weight: str = "1.0") -> str:
    return f"""WITH {_SIDES}, p AS (SELECT a, b, label, {_DIST[metric]} AS x FROM q, t WHERE a <> b), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY x, b) <= 5),
v AS (SELECT a, label, sum({weight}) AS w FROM k GROUP BY 1, 2) SELECT a AS q_id, label AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, label) = 1"""


@query(_knn_sql("euclidean"))
def knn_euclidean(spark, d):
    return N.knn_classify(_near(spark, d, "euclidean"))


@query(_knn_sql("manhattan"))
def knn_manhattan(spark, d):
    return N.knn_classify(_near(spark, d, "manhattan"))


@query(_knn_sql("cosine", "1 / (x + 1e-8)"))
def knn_cosine_weighted(spark, d):
    return N.knn_classify(_near(spark, d, "cosine"), "distance")


@query(f"""WITH {_SIDES}, p AS (SELECT a, b, label, {_DIST['euclidean']} AS x FROM q, t WHERE a <> b), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY x, b) <= 5)
SELECT a AS q_id, round(sum(label / (x + 1e-8)) / sum(1 / (x + 1e-8)), 6) AS prediction FROM k GROUP BY 1""")
def knn_regress(spark, d):
    return rounded(N.knn_regress(_near(spark, d, "euclidean"), "distance"))


@query(f"""WITH {_SIDES}, p AS (SELECT a, b, label, {_DIST['euclidean']} AS x FROM q, t WHERE a <> b), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY x, b) <= 5)
SELECT a AS q_id, label, round(count(*) / 5, 6) AS probability FROM k GROUP BY 1, 2""")
def knn_probability(spark, d):
    return rounded(N.knn_probabilities(_near(spark, d, "euclidean")))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(exp(-0.5 * list_distance(a.u, b.u) * list_distance(a.u, b.u)), 6) AS rbf, round(pow(0.5 * list_dot_product(a.u, b.u) + 1, 3), 6) AS poly, round(tanh(0.5 * list_dot_product(a.u, b.u)), 6) + 0.0 AS sigmoid FROM v a JOIN v b ON a.vec_id < b.vec_id""")
def kernels(spark, d):
    p = N.ordered_pairs(table(spark, d, "embeddings"), "vec_id", "embedding")
    u, x = F.col("u"), F.col("w")
    return rounded(p.select("a", "b", S.kernel(u, x, "rbf", 0.5).alias("rbf"), S.kernel(u, x, "poly", 0.5, 3, 1.0).alias("poly"), S.kernel(u, x, "sigmoid", 0.5).alias("sigmoid")))


@query("""WITH r AS (SELECT [s, s / 2, 0.0] AS v, id FROM (SELECT event_id AS id, value / 100 AS s FROM events)), e AS (SELECT id, list_transform(v, lambda x: exp(x - list_max(v))) AS p FROM r)
SELECT id, round(p[1] / list_sum(p), 6) AS p0, round(1 / (1 + exp(-v[1])), 6) AS sig FROM e JOIN r USING (id)""")
def softmax_sigmoid(spark, d):
    r = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("s"))
    return rounded(r.select("id", S.softmax(F.array(F.col("s"), F.col("s") / 2, F.lit(0.0)))[0].alias("p0"), S.sigmoid(F.col("s")).alias("sig")))


# --- clusters

_CENTERS = [[50.0, 6.0], [150.0, 12.0], [250.0, 18.0]]
_C_SQL = "c AS (SELECT * FROM (VALUES (0, 50.0::DOUBLE, 6.0::DOUBLE), (1, 150.0, 12.0), (2, 250.0, 18.0)) AS x(k, cx, cy)), e AS (SELECT event_id AS id, value AS x, CAST(hour(ts) AS DOUBLE) AS y FROM events), a AS (SELECT id, x, y, k, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM e, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), k) = 1)"


def _points(spark, d):
    return table(spark, d, "events").select("event_id", F.array("value", F.hour("ts").cast("double")).alias("v"))


@query(f"WITH {_C_SQL} SELECT CAST(k AS INTEGER) AS cluster, count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM a GROUP BY k")
def kmeans_step(spark, d):
    s = N.kmeans_step(_points(spark, d), _CENTERS, "v")
    return rounded(s.select("cluster", "n", F.col("center")[0].alias("cx"), F.col("center")[1].alias("cy")))


@query(f"WITH {_C_SQL} SELECT round(sum(d2), 3) AS inertia FROM a")
def kmeans_inertia(spark, d):
    return N.assign(_points(spark, d), _CENTERS, "v").agg(F.round(F.sum("d2"), 3).alias("inertia"))


@query(f"WITH {_C_SQL} SELECT id AS event_id, CAST(k AS INTEGER) AS cluster FROM a")
def nearest_center(spark, d):
    return N.assign(_points(spark, d), _CENTERS, "v").select("event_id", "cluster")


_DB = "e AS (SELECT event_id AS id, value AS x, CAST(hour(ts) AS DOUBLE) AS y FROM events), n AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x <= b.x + 2.1 AND a.x >= b.x - 2.1 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2.0)"


def _grid(spark, d):
    return table(spark, d, "events").select("event_id", F.col("value").alias("x"), F.hour("ts").cast("double").alias("y"))


@query(f"WITH {_DB} SELECT a, b FROM n")
def range_join(spark, d):
    return N.within(_grid(spark, d), "event_id", ["x", "y"], 2.0)


@query(f"WITH {_DB} SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 4")
def dbscan_core(spark, d):
    return N.dbscan(_grid(spark, d), "event_id", ["x", "y"], 2.0, 4).where("is_core").select("id")


@query()
def dbscan_labels(spark, d):
    """Without SQL: the closure of all pairs is too large for it."""
    return N.dbscan(_grid(spark, d), "event_id", ["x", "y"], 2.0, 4)


@query("""WITH e AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v, label AS l FROM embeddings), p AS (SELECT a.i, a.l AS la, b.l AS lb, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3),
c AS (SELECT i, max(s / (n - 1)) FILTER (WHERE la = lb AND n > 1) AS a, min(s / n) FILTER (WHERE la <> lb) AS b FROM p GROUP BY i) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM c""")
def silhouette(spark, d):
    return rounded(M.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label"))


@query()
def kmeans_fit(spark, d):
    rows = models.assemble(table(spark, d, "events").select("value", F.hour("ts").alias("h")))
    return models.KMeans(3, 20, n_init=2).fit_predict(rows).groupBy("prediction").agg(F.count("*").alias("n"))


@query(f"""WITH {_C_SQL}, m AS (SELECT k, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM a GROUP BY k), t AS (SELECT avg(x) AS tx, avg(y) AS ty, count(*) AS n, count(DISTINCT k) AS g FROM a),
w AS (SELECT k, avg(sqrt((x - mx) * (x - mx) + (y - my) * (y - my))) AS s, sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS w FROM a JOIN m USING (k) GROUP BY k),
r AS (SELECT p.k, max((u.s + v.s) / sqrt((p.mx - q.mx) * (p.mx - q.mx) + (p.my - q.my) * (p.my - q.my))) AS r FROM m p JOIN m q ON p.k <> q.k JOIN w u ON u.k = p.k JOIN w v ON v.k = q.k GROUP BY p.k)
SELECT round((SELECT sum(m.n * ((mx - tx) * (mx - tx) + (my - ty) * (my - ty))) FROM m, t) / (SELECT g - 1 FROM t) / ((SELECT sum(w) FROM w) / (SELECT n - g FROM t)), 4) AS calinski_harabasz, round((SELECT avg(r) FROM r), 6) AS davies_bouldin""")
def cluster_scores(spark, d):
    s = M.center_scores(N.assign(_points(spark, d), _CENTERS, "v"), "v", "cluster")
    return s.select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


# --- linear models and trees


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def ols_simple(spark, d):
    m = models.LinearRegression().fit(models.assemble(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice"))
    return spark.createDataFrame([(round(m.coef_[0], 4), round(m.intercept_, 4))], "slope double, intercept double")


@query("""WITH s AS (SELECT covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_discount, l_extendedprice) AS dy, covar_pop(l_quantity, l_discount) AS ab, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
w AS (SELECT (qy * bb - dy * ab) / (aa * bb - ab * ab) AS a, (dy * aa - qy * ab) / (aa * bb - ab * ab) AS b, ma, mb, my FROM s) SELECT round(a, 3) AS a, round(b, 3) AS b, round(my - a * ma - b * mb, 3) AS intercept FROM w""")
def ols_two(spark, d):
    m = models.LinearRegression().fit(models.assemble(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice"))
    return spark.createDataFrame([(round(m.coef_[0], 3), round(m.coef_[1], 3), round(m.intercept_, 3))], "a double, b double, intercept double")


@query("SELECT round(covar_pop(x, y) / (var_pop(x) + 0.5), 5) AS slope FROM (SELECT l_quantity / 10 AS x, 3 * l_quantity / 10 - 2 * l_discount + 1 AS y FROM lineitem)")
def ridge_slope(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_quantity") / 10).alias("x"), (3 * F.col("l_quantity") / 10 - 2 * F.col("l_discount") + 1).alias("y"))
    m = models.Ridge(0.5).fit(models.assemble(t, ["x"], "y"))
    return spark.createDataFrame([(round(m.coef_[0], 5),)], "slope double")


def _thresholds(feature: str, label: str, impurity: str) -> str:
    return f"""WITH r AS (SELECT {feature} AS x, {label} AS y FROM lineitem), v AS (SELECT DISTINCT x FROM r), m AS (SELECT (x + lead(x) OVER (ORDER BY x)) / 2 AS t FROM v),
s AS (SELECT t, x <= t AS l, y FROM r, m WHERE t IS NOT NULL), {impurity},
b AS (SELECT t, sum(n * i) / sum(n) AS impurity, CAST(sum(CASE WHEN l THEN n ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN l THEN 0 ELSE n END) AS BIGINT) AS n_right FROM g GROUP BY t)
SELECT t AS threshold, round(impurity, 6) AS impurity, n_left, n_right FROM b ORDER BY round(b.impurity, 9), t LIMIT 1"""


def _stump(spark, d, label, criterion):
    return rounded(models.best_stump(table(spark, d, "lineitem"), "l_tax", label, criterion))


@query(_thresholds("l_tax", "l_returnflag", "c AS (SELECT t, l, y, count(*) AS k FROM s GROUP BY 1, 2, 3), g AS (SELECT t, l, sum(k) AS n, 1 - sum(k * k) / (sum(k) * sum(k)) AS i FROM c GROUP BY 1, 2)"))
def best_stump_gini(spark, d):
    return _stump(spark, d, "l_returnflag", "gini")


@query(_thresholds("l_tax", "l_returnflag", "c AS (SELECT t, l, y, count(*) AS k FROM s GROUP BY 1, 2, 3), h AS (SELECT t, l, k, sum(k) OVER (PARTITION BY t, l) AS n FROM c), g AS (SELECT t, l, sum(k) AS n, -sum(k / n * log2(k / n)) AS i FROM h GROUP BY 1, 2)"))
def best_stump_entropy(spark, d):
    return _stump(spark, d, "l_returnflag", "entropy")


@query(_thresholds("l_tax", "l_quantity", "g AS (SELECT t, l, count(*) AS n, var_pop(y) AS i FROM s GROUP BY 1, 2)"))
def best_stump_mse(spark, d):
    return _stump(spark, d, "l_quantity", "mse")


@query(_thresholds("l_tax", "l_quantity", "c AS (SELECT t, l, quantile_disc(y, 0.5) AS m FROM s GROUP BY 1, 2), g AS (SELECT t, l, count(*) AS n, avg(abs(y - m)) AS i FROM s JOIN c USING (t, l) GROUP BY 1, 2)"))
def best_stump_mae(spark, d):
    return _stump(spark, d, "l_quantity", "mae")


def _signal(spark, d, label):
    t = table(spark, d, "lineitem")
    y = (3 * F.col("l_quantity") - 2 * F.col("l_discount") + 1) if label == "number" else F.when(F.col("l_quantity") > 25, "big").otherwise("small")
    rows = t.select("l_orderkey", "l_quantity", "l_discount", y.alias("y"))
    return models.assemble(rows, ["l_quantity", "l_discount"], "y", ["l_orderkey"])


def _scored(spark, model, rows):
    a, b = rows.where("l_orderkey % 50 <> 0"), rows.where("l_orderkey % 50 = 0")
    return spark.createDataFrame([(type(model).__name__, float(model.fit(a).score(b)))], "model string, score double")


def _linear_score(name: str, alpha: float) -> str:
    """Coefficient of determination on the held-out orders of the closed form fitted on the others."""
    return f"""WITH r AS (SELECT l_orderkey % 50 = 0 AS test, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, 3 * l_quantity - 2 * l_discount + 1 AS y FROM lineitem),
s AS (SELECT var_pop(a) + {alpha} AS aa, var_pop(b) + {alpha} AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM r WHERE NOT test),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS u, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS v, ma, mb, my FROM s),
p AS (SELECT y, u * (a - ma) + v * (b - mb) + my AS z FROM r, w WHERE test)
SELECT '{name}' AS model, round(1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*)), 7) AS score FROM p"""


def _model_query(name: str, label: str, sql: str | None = None, **params):
    def run(spark, d):
        out = _scored(spark, models.REGISTRY[name](**params), _signal(spark, d, label))
        return out.withColumn("score", F.round("score", 7)) if sql else out

    run.__name__ = f"model_{name.lower()}"
    query(sql)(run)


for _name, _label, _params in (
    ("LinearRegression", "number", {}),
    ("Ridge", "number", {"alpha": 0.1}),
    ("Lasso", "number", {"alpha": 0.1}),
    ("DecisionTreeRegressor", "number", {"max_depth": 6}),
    ("RandomForestRegressor", "number", {"n_estimators": 8, "max_depth": 6}),
    ("BaggingRegressor", "number", {"n_estimators": 3}),
    ("SVMRegressor", "number", {"epochs": 12}),
    ("KNNRegressor", "number", {}),
    ("LogisticRegression", "class", {"epochs": 30}),
    ("DecisionTreeClassifier", "class", {"max_depth": 4}),
    ("RandomForestClassifier", "class", {"n_estimators": 8, "max_depth": 4}),
    ("BaggingClassifier", "class", {"n_estimators": 3}),
    ("SVMClassifier", "class", {"kernel": "linear", "epochs": 20}),
    ("KNNClassifier", "class", {}),
):
    _model_query(_name, _label, _linear_score(_name, _params.get("alpha", 0.0)) if _name in ("LinearRegression", "Ridge") else None, **_params)


# --- metrics, votes, tuning

_PRED = "p AS (SELECT l_quantity AS y, 2 * l_linenumber + 20 AS z, CAST(l_quantity > 25 AS INTEGER) AS c, CAST(l_linenumber > 3 AS INTEGER) AS k FROM lineitem)"


def _predictions(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_quantity").alias("y"), (2 * F.col("l_linenumber") + 20).alias("z"), (F.col("l_quantity") > 25).cast("int").alias("c"), (F.col("l_linenumber") > 3).cast("int").alias("k"))


@query(f"""WITH {_PRED} SELECT round(avg(CAST(c = k AS DOUBLE)), 6) AS accuracy, round(1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*)), 6) AS r2, round(avg((y - z) * (y - z)), 6) AS mse, round(sqrt(avg((y - z) * (y - z))), 6) AS rmse, round(avg(abs(y - z)), 6) AS mae FROM p""")
def accuracy_r2_mse(spark, d):
    p = _predictions(spark, d)
    m = p.agg(M.accuracy("k", "c").alias("accuracy"), M.r2("z", "y").alias("r2"), M.mse("z", "y").alias("mse"), F.sqrt(M.mse("z", "y")).alias("rmse"), M.mae("z", "y").alias("mae"))
    return rounded(m)


@query(f"""WITH {_PRED}, g AS (SELECT l AS label, (SELECT count(*) FROM p WHERE c = l) AS support, (SELECT count(*) FROM p WHERE k = l) AS said, (SELECT count(*) FROM p WHERE c = l AND k = l) AS hit FROM (VALUES (0), (1)) AS x(l))
SELECT label, round(hit / said, 6) AS precision, round(hit / support, 6) AS recall, round(2 * (hit / said) * (hit / support) / (hit / said + hit / support), 6) AS f1, support FROM g""")
def precision_recall_f1(spark, d):
    return rounded(M.class_metrics(_predictions(spark, d), "k", "c"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, unnest([l_linenumber % 3, CAST(l_quantity AS BIGINT) % 3, l_partkey % 3]) AS p FROM lineitem), c AS (SELECT l_orderkey, l_linenumber, p, count(*) AS n FROM v GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber, p AS vote FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY n DESC, p) = 1""")
def bagging_vote(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_orderkey").isNotNull())
    votes = F.array((F.col("l_linenumber") % 3).cast("long"), F.col("l_quantity").cast("long") % 3, F.col("l_partkey") % 3)
    cast = t.groupBy("l_orderkey", "l_linenumber").agg(F.flatten(F.collect_list(votes)).alias("votes"))
    return cast.select("l_orderkey", "l_linenumber", models.most_votes(models.vote_shares(F.col("votes"), 3)).cast("long").alias("vote"))


_BOARD = "b AS (SELECT o_orderpriority AS model, avg(o_totalprice) / 1e6 AS score, avg(o_totalprice) / 1e6 - 0.01 * (count(*) % 7) AS cv_mean, 0.001 * (count(*) % 50) AS cv_std, CAST(count(*) AS DOUBLE) AS seconds, CAST(count(*) % 5 AS INTEGER) AS n_params FROM orders GROUP BY 1)"


def _board(spark, d):
    n = F.count("*")
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model"))
    s = F.avg("o_totalprice") / 1e6
    return g.agg(s.alias("score"), (s - 0.01 * (n % 7)).alias("cv_mean"), (0.001 * (n % 50)).alias("cv_std"), n.cast("double").alias("seconds"), (n % 5).cast("int").alias("n_params"))


@query(f"WITH {_BOARD} SELECT CAST(row_number() OVER (ORDER BY score DESC, model) AS INTEGER) AS rank, model, round(score, 6) AS score FROM b")
def leaderboard_rank(spark, d):
    return rounded(automl.ranked(_board(spark, d)).select("rank", "model", "score"))


@query(f"""WITH {_BOARD}, x AS (SELECT *, greatest(score - cv_mean, 0) AS gap, max(seconds) OVER () AS ms, max(n_params) OVER () AS mp FROM b)
SELECT model, gap > 0.05 AS overfit, cv_std > 0.10 AS rejected, round(0.40 * score + 0.25 * (1 - least(cv_std / 0.10, 1)) + 0.20 * (1 - least(gap / 0.05, 1)) + 0.10 * (1 - seconds / ms) + 0.05 * (1 - CASE WHEN mp = 0 THEN 0 ELSE n_params / mp END), 6) AS rubric FROM x""")
def rubric_score(spark, d):
    return rounded(automl.rubric(_board(spark, d)).select("model", "overfit", "rejected", "rubric"))


@query("SELECT mode, CAST(CASE WHEN n * 11 < 10000 THEN 30 WHEN n * 11 < 500000 THEN 60 WHEN n * 11 < 20000000 THEN 120 ELSE 300 END * k AS INTEGER) AS seconds, t AS trials FROM (SELECT count(*) AS n FROM lineitem), (VALUES ('basic', 1, 3), ('medium', 2, 6), ('full', 4, 10)) AS x(mode, k, t)")
def budget_heuristic(spark, d):
    n = table(spark, d, "lineitem").count()
    return spark.createDataFrame([(m, *automl.time_budget(n, 11, m)) for m in ("basic", "medium", "full")], "mode string, seconds int, trials int")


@query()
def automl_classification(spark, d):
    rows = _signal(spark, d, "class")
    a, b = rows.where("l_orderkey % 50 <> 0").drop("l_orderkey"), rows.where("l_orderkey % 50 = 0").drop("l_orderkey")
    return automl.AutoML("classification", a, b, 60, 1, 2, only=["LogisticRegression", "DecisionTreeClassifier"]).fit().leaderboard().drop("seconds")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), c AS (SELECT event_id, event_type, least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS v FROM events, q),
f AS (SELECT event_type, count(*) / (SELECT count(event_type) FROM events) AS share FROM events GROUP BY 1), m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
SELECT event_id, round(share, 6) AS event_type, round((v - m) / s, 6) AS value FROM c JOIN f USING (event_type), m""")
def streaming_replay(spark, d):
    """A fitted pipeline run over a stream of events."""
    import uuid

    from plumbline.operators import prep
    from plumbline.streaming import replay

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    at = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    stages = [prep.fit_winsorize(e, ["value"]), prep.fit_frequency(e, ["event_type"]), prep.fit_scale(e, ["value"])]
    e.write.parquet(f"{at}/in")
    replay.run_available(replay.replay(replay.read_stream(spark, f"{at}/in", e.schema), stages), f"{at}/out", f"{at}/state")
    return rounded(spark.read.parquet(f"{at}/out"))
