"""Queries of the preprocessing stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import HOLES, holes, query, rounded, table
from plumbline.operators import prep as P
from plumbline.plans.plan import Plan, Preparer

_KEYS = ["l_orderkey", "l_linenumber"]


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(q, (SELECT avg(q) FROM {HOLES})), 6) AS q FROM {HOLES}")
def impute_mean(spark, d):
    t = holes(spark, d).select(*_KEYS, "q")
    return rounded(P.fit_impute(t, ["q"], "mean").transform(t))


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(d, (SELECT quantile_cont(d, 0.5) FROM {HOLES})), 6) AS d FROM {HOLES}")
def impute_median(spark, d):
    t = holes(spark, d).select(*_KEYS, "d")
    return rounded(P.fit_impute(t, ["d"], "median").transform(t))


@query(f"SELECT l_orderkey, l_linenumber, coalesce(f, (SELECT f FROM {HOLES} WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1)) AS f FROM {HOLES}")
def impute_mode(spark, d):
    t = holes(spark, d).select(*_KEYS, "f")
    return P.fit_impute_categorical(t, ["f"]).transform(t)


@query("""SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo,
  quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)""")
def winsorize_iqr(spark, d):
    t = table(spark, d, "events").select("event_id", "value")
    return rounded(P.fit_winsorize(t, ["value"]).transform(t))


@query("SELECT event_id, round(least(greatest(value, m - 2 * s), m + 2 * s), 6) AS value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)")
def winsorize_gaussian(spark, d):
    t = table(spark, d, "events").select("event_id", "value")
    return rounded(P.fit_winsorize(t, ["value"], "gaussian", 2.0).transform(t))


@query("""SELECT event_id, round(least(greatest(value, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)), 6) AS value FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""")
def winsorize_target(spark, d):
    t = table(spark, d, "events").select("event_id", "value")
    return rounded(P.fit_winsorize_target(t, "value").transform(t))


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS event_type FROM events")
def label_encode(spark, d):
    t = table(spark, d, "events").select("event_id", "event_type")
    return P.fit_label_encode(t, "event_type").transform(t)


@query("SELECT event_id, event_type FROM events")
def label_round_trip(spark, d):
    t = table(spark, d, "events").select("event_id", "event_type")
    f = P.fit_label_encode(t, "event_type")
    return P.inverse_label(f.transform(t), f, "event_type")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'A' AS INTEGER) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS INTEGER) AS "l_returnflag_N", CAST(l_returnflag = 'R' AS INTEGER) AS "l_returnflag_R" FROM lineitem""")
def onehot(spark, d):
    t = table(spark, d, "lineitem").select(*_KEYS, "l_returnflag")
    return P.fit_onehot(t, ["l_returnflag"]).transform(t)


@query("SELECT p_partkey, round(count(*) OVER (PARTITION BY p_brand) / count(*) OVER (), 6) AS p_brand FROM part")
def frequency_encode(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_brand")
    return rounded(P.fit_frequency(t, ["p_brand"]).transform(t))


@query("""WITH m AS (SELECT avg(p_retailprice) AS m FROM part) SELECT p_partkey, round((sum(p_retailprice) OVER (PARTITION BY p_brand) + 10 * m) / (count(*) OVER (PARTITION BY p_brand) + 10), 6) AS p_brand, p_retailprice FROM part, m""")
def target_encode(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return rounded(P.fit_target_encoding(t, ["p_brand"], "p_retailprice").transform(t))


@query("SELECT c_custkey, round(ln(c_acctbal + CASE WHEN m <= 0 THEN 1 - m ELSE 0 END), 6) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS m FROM customer)")
def log_shift(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(P.fit_log(t, ["c_acctbal"]).transform(t))


@query("SELECT c_custkey, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - x, 1.5) - 1) / 1.5 END, 6) AS x FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)")
def yeo_johnson_fixed(spark, d):
    t = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"))
    return rounded(P.Fitted("yeo_johnson", {"powers": {"x": 0.5}}).transform(t))


_LL = "-count(value) / 2 * ln(var_pop((pow(value + 1, {p}) - 1) / {p})) + ({p} - 1) * sum(sign(value) * ln(1 + abs(value)))"


@query(" UNION ALL ".join(f"SELECT {p}::DOUBLE AS power, round({_LL.format(p=p)}, 4) AS ll FROM events" for p in (0.25, 0.5, 1.0)))
def yj_loglik_grid(spark, d):
    t = table(spark, d, "events")
    powers = (0.25, 0.5, 1.0)
    one = t.agg(*(P.log_likelihood(F.col("value"), p).alias(f"x{i}") for i, p in enumerate(powers)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(p).alias("power"), F.round(f"x{i}", 4).alias("ll")) for i, p in enumerate(powers)))))


@query()
def yeo_johnson_fit(spark, d):
    t = table(spark, d, "events").select("event_id", "value")
    return P.fit_yeo_johnson(t, ["value"]).transform(t)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def scale_standard(spark, d):
    t = table(spark, d, "lineitem").select(*_KEYS, "l_quantity")
    return rounded(P.fit_scale(t, ["l_quantity"]).transform(t))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - a) / (b - a), 6) AS l_quantity FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem)")
def scale_minmax(spark, d):
    t = table(spark, d, "lineitem").select(*_KEYS, "l_quantity")
    return rounded(P.fit_scale(t, ["l_quantity"], "minmax").transform(t))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - b) / (c - a), 6) AS l_quantity FROM lineitem, (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.5) AS b, quantile_cont(l_quantity, 0.75) AS c FROM lineitem)")
def scale_robust(spark, d):
    t = table(spark, d, "lineitem").select(*_KEYS, "l_quantity")
    return rounded(P.fit_scale(t, ["l_quantity"], "robust").transform(t))


def _wide(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_tax", F.lit(1).alias("k"), F.col("l_tax").alias("tax2"), (2 * F.col("l_tax") + 1).alias("tax3"))


@query("""SELECT 'k' AS "column", 1.0::DOUBLE AS share UNION ALL SELECT 'l_linestatus', round(max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_linestatus)""")
def constant_columns(spark, d):
    t = table(spark, d, "lineitem").select(F.lit(1).alias("k"), "l_linestatus")
    return rounded(P.constant_shares(t))


@query("SELECT l_quantity, l_tax, tax2, tax3 FROM (SELECT l_quantity, l_tax, l_tax AS tax2, 2 * l_tax + 1 AS tax3 FROM lineitem)")
def drop_constant(spark, d):
    t = _wide(spark, d)
    return P.fit_drop_constant(t).transform(t)


_WIDE = "w AS (SELECT 1 AS k, l_quantity, l_tax, l_tax AS tax2, 2 * l_tax + 1 AS tax3 FROM lineitem)"


@query(f"""WITH {_WIDE}, p AS (SELECT * FROM (VALUES
  ('l_quantity', 'l_tax', (SELECT bool_and(l_quantity IS NOT DISTINCT FROM l_tax) FROM w)), ('l_quantity', 'tax2', (SELECT bool_and(l_quantity IS NOT DISTINCT FROM tax2) FROM w)),
  ('l_quantity', 'tax3', (SELECT bool_and(l_quantity IS NOT DISTINCT FROM tax3) FROM w)), ('l_tax', 'tax2', (SELECT bool_and(l_tax IS NOT DISTINCT FROM tax2) FROM w)),
  ('l_tax', 'tax3', (SELECT bool_and(l_tax IS NOT DISTINCT FROM tax3) FROM w)), ('tax2', 'tax3', (SELECT bool_and(tax2 IS NOT DISTINCT FROM tax3) FROM w))) AS x(kept, duplicate, same))
SELECT min(kept) AS kept, duplicate FROM p WHERE same GROUP BY duplicate""")
def duplicate_columns(spark, d):
    return spark.createDataFrame(P.duplicate_pairs(_wide(spark, d)), "kept string, duplicate string")


@query(f"""WITH {_WIDE}, c AS (SELECT abs(corr(l_quantity, l_tax)) > 0.95 AS t1, abs(corr(l_quantity, tax2)) > 0.95 AS q2, abs(corr(l_tax, tax2)) > 0.95 AS t2, abs(corr(l_quantity, tax3)) > 0.95 AS q3, abs(corr(l_tax, tax3)) > 0.95 AS t3, abs(corr(tax2, tax3)) > 0.95 AS d3 FROM w),
g AS (SELECT t1, q2 OR (t2 AND NOT t1) AS g2, q3 OR (t3 AND NOT t1) OR (d3 AND NOT (q2 OR (t2 AND NOT t1))) AS g3 FROM c)
SELECT x.column, x.gone FROM g, (VALUES ('l_quantity'), ('l_tax'), ('tax2'), ('tax3')) AS n(name), LATERAL (SELECT n.name AS "column", CASE n.name WHEN 'l_tax' THEN t1 WHEN 'tax2' THEN g2 WHEN 'tax3' THEN g3 ELSE false END AS gone) AS x""")
def correlated_drop(spark, d):
    t = _wide(spark, d).drop("k")
    kept = P.fit_drop_correlated(t).transform(t.limit(0)).columns
    return spark.createDataFrame([(c, c not in kept) for c in t.columns], "`column` string, gone boolean")


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, 0.2) AS a, quantile_cont(o_totalprice, 0.4) AS b, quantile_cont(o_totalprice, 0.6) AS c, quantile_cont(o_totalprice, 0.8) AS d FROM orders)
SELECT o_orderkey, 'o_totalprice_bin_' || CASE WHEN o_totalprice <= a THEN 0 WHEN o_totalprice <= b THEN 1 WHEN o_totalprice <= c THEN 2 WHEN o_totalprice <= d THEN 3 ELSE 4 END AS o_totalprice FROM orders, e""")
def quantile_bins(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return P.fit_bins(t, ["o_totalprice"]).transform(t)


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) / count(*) OVER () >= 0.04 THEN p_brand ELSE 'other' END AS p_brand FROM part")
def rare_bucket(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_brand")
    return P.fit_rare(t, ["p_brand"], 0.04).transform(t)


@query("""SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)""")
def forward_fill(spark, d):
    t = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return P.forward_fill(t, "v", ["user_id"], ["ts", "event_id"]).select("event_id", "v")


@query(f"""WITH t AS (SELECT * FROM {HOLES}), tr AS (SELECT * FROM t WHERE l_orderkey % 5 <> 0),
s AS (SELECT avg(q) AS qm, (SELECT f FROM tr WHERE f IS NOT NULL GROUP BY f ORDER BY count(*) DESC, f LIMIT 1) AS fm FROM tr),
i AS (SELECT avg(coalesce(q, qm)) AS m, stddev_pop(coalesce(q, qm)) AS sd FROM tr, s)
SELECT l_orderkey, l_linenumber, round((coalesce(q, qm) - m) / sd, 6) AS q, CAST(coalesce(f, fm) = 'A' AS INTEGER) AS "f_A", CAST(coalesce(f, fm) = 'N' AS INTEGER) AS "f_N", CAST(coalesce(f, fm) = 'R' AS INTEGER) AS "f_R"
FROM t, s, i WHERE l_orderkey % 5 = 0""")
def prep_fit_transform(spark, d):
    t = holes(spark, d).select(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_linenumber").cast("string").alias("l_linenumber"), "q", "f", (F.col("l_orderkey") % 5 == 0).alias("test"))
    p = Preparer("regression")
    plan = Plan(onehot=["f"], scaling="standard", scaling_columns=["q"])
    p.fit_transform(t.where("NOT test").drop("test"), plan)
    out = p.transform(t.where("test").drop("test"))
    return rounded(out.withColumns({c: F.col(c).cast(k) for c, k in (("l_orderkey", "long"), ("l_linenumber", "int"))}))


@query("SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderpriority)) AS items FROM orders GROUP BY 1")
def transactions_by_key(spark, d):
    return P.transactions_by_key(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity > 25 AS INTEGER) AS l_quantity, round(sqrt(l_discount), 6) AS l_discount FROM lineitem")
def binarize_sqrt(spark, d):
    t = table(spark, d, "lineitem").select(*_KEYS, "l_quantity", "l_discount")
    return rounded(P.Fitted("sqrt", {"columns": ["l_discount"]}).transform(P.Fitted("binarize", {"thresholds": {"l_quantity": 25.0}}).transform(t)))
