"""Queries of the profiler."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import columns as C
from plumbline.catalog.registry import HOLES, holes, query, rounded, table
from plumbline.functions.expressions import derive
from plumbline.operators import profile as P
from plumbline.operators import split

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _each(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.replace("$c", n) for n in names)


@query(_each("""SELECT '$c' AS "column", count($c) AS count, CAST(count(*) - count($c) AS BIGINT) AS missing, round(min($c), 6) AS min, round(max($c), 6) AS max, round(avg($c), 6) AS mean,
  round(stddev_samp($c), 6) AS std, round(var_samp($c), 6) AS variance, round(quantile_cont($c, 0.25), 6) AS q1, round(quantile_cont($c, 0.5), 6) AS median, round(quantile_cont($c, 0.75), 6) AS q3 FROM lineitem""", _NUM))
def profile_numeric(spark, d):
    return rounded(P.numeric_profile(table(spark, d, "lineitem"), _NUM))


@query(_each("""SELECT * FROM (SELECT '$c' AS "column", count(*) OVER () AS "distinct", v AS top, n AS freq, round(n / (SELECT count(*) FROM lineitem), 6) AS support, count(*) OVER () < 20 AS likely_categorical
  FROM (SELECT $c AS v, count(*) AS n FROM lineitem WHERE $c IS NOT NULL GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, v) = 1)""", ["l_returnflag", "l_linestatus"]))
def profile_categorical(spark, d):
    return rounded(P.categorical_profile(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]))


@query("""SELECT 'p_brand' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS rank, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand QUALIFY rank <= 10""")
def value_counts_top10(spark, d):
    return P.top_values(table(spark, d, "part"), ["p_brand"], 10)


@query("""SELECT "column", rank, value, n FROM (SELECT 'p_type' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS rank, p_type AS value, count(*) AS n FROM part GROUP BY p_type) WHERE rank <= 3""")
def top3_items(spark, d):
    return P.top_values(table(spark, d, "part"), ["p_type"], 3)


@query("SELECT (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS size_mode, (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS brand_mode")
def mode_smallest_tie(spark, d):
    return table(spark, d, "part").agg(F.mode("p_size", True).alias("size_mode"), F.mode("p_brand", True).alias("brand_mode"))


@query(_each(f"""SELECT '$c' AS "column", CAST(count(*) - count($c) AS BIGINT) AS missing, round((count(*) - count($c)) * 100.0::DOUBLE / count(*), 6) AS percent FROM {HOLES}""", ["q", "d", "f"]))
def missing_report(spark, d):
    return rounded(P.missing(holes(spark, d).select("q", "d", "f")))


@query("""SELECT 'o_orderstatus' AS "column", round(max(n) / sum(n), 6) AS support FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
UNION ALL SELECT 'o_totalprice', round(count(o_totalprice) / count(*), 6) FROM orders""")
def column_support(spark, d):
    o = table(spark, d, "orders")
    number = o.agg(F.lit("o_totalprice").alias("column"), (F.count("o_totalprice") / F.count("*")).alias("support"))
    return rounded(P.categorical_profile(o, ["o_orderstatus"]).select("column", "support").unionByName(number))


@query("""SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) < 20 AS likely FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) < 20 FROM lineitem""")
def likely_categorical(spark, d):
    return P.categorical_profile(table(spark, d, "lineitem"), ["l_returnflag", "l_partkey"]).select("column", F.col("likely_categorical").alias("likely"))


@query("""SELECT 'o_orderpriority' AS "column", CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS rank, v AS value FROM (SELECT DISTINCT o_orderpriority AS v FROM orders) QUALIFY rank <= 5""")
def sample_values(spark, d):
    return P.sample_values(table(spark, d, "orders"), ["o_orderpriority"])


@query("SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def shape(spark, d):
    t = table(spark, d, "lineitem")
    return t.agg(F.count("*").alias("rows"), F.lit(len(t.columns)).cast("long").alias("columns"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT f) AS flags FROM (SELECT l_partkey, l_suppkey, CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END AS f FROM lineitem)")
def distinct_counts(spark, d):
    t = table(spark, d, "lineitem").withColumn("f", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_returnflag")))
    counts = P.value_counts(t, ["l_partkey", "l_suppkey", "f"]).groupBy("column").agg(F.count("*").alias("n"))
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("column") == c, F.col("n"))), F.lit(0))
    return counts.agg(pick("l_partkey").alias("parts"), pick("l_suppkey").alias("suppliers"), pick("f").alias("flags"))


@query("""WITH e AS (SELECT value AS x FROM events), b AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM e),
l AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b)
SELECT 'value' AS "column", round(lower, 6) AS lower, round(upper, 6) AS upper, (SELECT count(*) FROM e, l WHERE x < lower OR x > upper) AS outliers FROM l""")
def iqr_outliers(spark, d):
    return rounded(P.outliers(table(spark, d, "events"), ["value"]))


@query(_each("SELECT '$c' AS \"column\", round(stddev_samp($c) / avg($c), 6) AS cv FROM lineitem", _NUM))
def cv_coefficient(spark, d):
    return rounded(P.variation(table(spark, d, "lineitem"), _NUM))


@query("""WITH t AS (SELECT l_quantity AS a, 2 * l_quantity + l_discount AS b, l_tax AS c FROM lineitem),
p AS (SELECT 'a' AS a, 'b' AS b, corr(a, b) AS r FROM t UNION ALL SELECT 'a', 'c', corr(a, c) FROM t UNION ALL SELECT 'b', 'c', corr(b, c) FROM t)
SELECT a, b, round(r, 6) AS r FROM p WHERE abs(r) > 0.7""")
def correlation_pairs(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), (2 * F.col("l_quantity") + F.col("l_discount")).alias("b"), F.col("l_tax").alias("c"))
    return rounded(P.correlations(t, ["a", "b", "c"]))


@query(f"""WITH t AS (SELECT q, d, f FROM {HOLES}), n AS (SELECT count(*) AS n FROM t),
m AS (SELECT ((n - (SELECT count(q) FROM t)) * 100.0::DOUBLE / n + (n - (SELECT count(d) FROM t)) * 100.0::DOUBLE / n + (n - (SELECT count(f) FROM t)) * 100.0::DOUBLE / n) / 3 AS p FROM n),
b AS (SELECT quantile_cont(q, 0.25) AS a1, quantile_cont(q, 0.75) AS a3, quantile_cont(d, 0.25) AS b1, quantile_cont(d, 0.75) AS b3 FROM t),
o AS (SELECT count(*) FILTER (WHERE q < a1 - 1.5 * (a3 - a1) OR q > a3 + 1.5 * (a3 - a1)) + count(*) FILTER (WHERE d < b1 - 1.5 * (b3 - b1) OR d > b3 + 1.5 * (b3 - b1)) AS o FROM t, b)
SELECT n AS rows, CAST(3 AS BIGINT) AS columns, round(greatest(0, 100 - p), 2) AS completeness, round(least(50, o * 100.0::DOUBLE / n), 2) AS penalty,
  round(greatest(0, least(100, greatest(0, 100 - p) - least(50, o * 100.0::DOUBLE / n))), 2) AS score FROM n, m, o""")
def quality_score(spark, d):
    return P.quality_score(holes(spark, d).select("q", "d", "f"))


@query("SELECT quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def class_balance(spark, d):
    return P.class_distribution(table(spark, d, "labels"), "quality")


@query("SELECT count(*) AS classes, round(max(n) / min(n), 6) AS ratio FROM (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label)")
def imbalance_ratio(spark, d):
    return rounded(P.imbalance(table(spark, d, "embeddings"), "label"))


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def target_stats(spark, d):
    return P.target_stats(table(spark, d, "orders"), "o_totalprice").select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max")


@query("""SELECT round(q / n - (s / n) * (s / n), 6) AS variance, round(m, 6) AS mean_std FROM (SELECT count(l_discount) + count(l_tax) AS n, sum(l_discount) + sum(l_tax) AS s,
  sum(l_discount * l_discount) + sum(l_tax * l_tax) AS q, (stddev_pop(l_discount) + stddev_pop(l_tax)) / 2 AS m FROM lineitem)""")
def cell_variance(spark, d):
    return rounded(P.cell_variance(table(spark, d, "lineitem"), ["l_discount", "l_tax"]))


@query("SELECT count(*) AS rows, count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority) AS total_items, round((count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority)) / 2, 6) AS mean_items FROM orders")
def assoc_totals(spark, d):
    return rounded(P.association_totals(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("SELECT event_id, TRY_CAST(x AS DOUBLE) AS x FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS x FROM events) WHERE TRY_CAST(x AS DOUBLE) IS NOT NULL")
def coerce_drop(spark, d):
    from plumbline.operators.prep import Fitted

    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("x"))
    return Fitted("numeric_target", {"target": "x"}).transform(e)


@query(f"SELECT l_orderkey, l_linenumber, q, f FROM {HOLES} WHERE q IS NOT NULL AND f IS NOT NULL")
def drop_rows_null(spark, d):
    from plumbline.operators.prep import Fitted

    return Fitted("drop_null_rows", {"columns": ["q", "f"]}).transform(holes(spark, d).select("l_orderkey", "l_linenumber", "q", "f"))


@query(f"SELECT l_orderkey, l_linenumber, coalesce(f, 'missing') AS f FROM {HOLES}")
def fill_constant(spark, d):
    from plumbline.operators.prep import fill_constant as fill

    return fill(["f"]).transform(holes(spark, d).select("l_orderkey", "l_linenumber", "f"))


@query("SELECT event_id, CAST(user_id AS INTEGER) AS user_id, event_type FROM events")
def safe_cast(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return C.cast_columns(e, {"user_idd": "int32", "event_type": "float64"})[0]


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END, 6) AS ratio, round(l_extendedprice * (1 - l_discount), 6) AS revenue,
  CAST(l_quantity > 25 AS BIGINT) AS bulk, l_returnflag || '_' || l_linestatus AS code FROM lineitem""")
def derived_features(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_discount", "l_quantity", "l_returnflag", "l_linestatus")
    out, _ = derive(t, ["df['ratio'] = df['l_extendedprice'] / df['l_tax']", "df['revenue'] = df['l_extendedprice'] * (1 - df['l_discount'])", "df['bulk'] = (df['l_quantity'] > 25).astype(int)", "df['code'] = df['l_returnflag'] + '_' + df['l_linestatus']", "df['x'] = df['absent'] + 1"])
    return rounded(out.select("l_orderkey", "l_linenumber", "ratio", "revenue", "bulk", "code"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def drop_columns(spark, d):
    from plumbline.operators.prep import Fitted

    t = table(spark, d, "lineitem")
    return Fitted("drop_columns", {"columns": [c for c in t.columns if c not in ("l_orderkey", "l_linenumber", "l_returnflag")]}).transform(t)


@query("SELECT p_size, p_retailprice FROM part")
def select_numeric(spark, d):
    t = table(spark, d, "part").drop("p_partkey")
    return t.select(*map(C.col, C.numeric(t)))


@query("SELECT event_id, value < (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events) OR value > (SELECT quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events) AS is_outlier FROM events")
def outlier_flags(spark, d):
    e = table(spark, d, "events")
    lo, hi = P.bounds(e, ["value"])["value"]
    return e.select("event_id", ((F.col("value") < lo) | (F.col("value") > hi)).alias("is_outlier"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_rows(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(10)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_join_rest(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return split.rest(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@query("SELECT l_orderkey, l_linenumber, f FROM " + HOLES + " WHERE f IS NOT NULL")
def filter_null_target(spark, d):
    from plumbline.operators.prep import Fitted

    return Fitted("drop_null_rows", {"columns": ["f"]}).transform(holes(spark, d).select("l_orderkey", "l_linenumber", "f"))
