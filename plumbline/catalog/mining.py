"""Queries of association mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import query, rounded, table
from plumbline.operators import association as A


def _orders(spark, d):
    """Distinct part types of each order."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return table(spark, d, "lineitem").join(p, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("items"))


_PAIRS = "b AS (SELECT DISTINCT l_orderkey AS o, p_type AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT o) AS n FROM b)"


@query("SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def baskets(spark, d):
    return _orders(spark, d)


@query("""SELECT l_orderkey, l_linenumber, list_sort(list_filter([CASE WHEN l_linenumber = 1 THEN 'l_linenumber' WHEN l_linenumber <> 0 THEN 'l_linenumber=' || l_linenumber END, 'l_returnflag=' || l_returnflag], lambda x: x IS NOT NULL)) AS items FROM lineitem""")
def row_items(spark, d):
    from plumbline.functions.scalar import item

    t = table(spark, d, "lineitem")
    items = F.array_compact(F.array(item("l_linenumber", F.col("l_linenumber"), True), item("l_returnflag", F.col("l_returnflag"), False)))
    return t.select("l_orderkey", "l_linenumber", F.array_sort(items).alias("items"))


@query(f"""WITH {_PAIRS}, f AS (
  SELECT [i] AS items, count(*) AS freq FROM b GROUP BY i
  UNION ALL SELECT [x.i, y.i], count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY x.i, y.i
  UNION ALL SELECT [x.i, y.i, z.i], count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i JOIN b z ON z.o = x.o AND y.i < z.i GROUP BY x.i, y.i, z.i)
SELECT items, freq, round(freq / n, 6) AS support FROM f, n WHERE freq >= 0.11 * n""")
def itemsets(spark, d):
    return rounded(A.itemsets(_orders(spark, d).select("items"), 0.11, 3))


@query(f"""WITH {_PAIRS}, f AS (SELECT [i] AS items, count(*) AS freq FROM b GROUP BY i
  UNION ALL SELECT [x.i, y.i], count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY x.i, y.i)
SELECT items, freq, round(freq / n, 6) AS support FROM f, n WHERE freq >= 0.2 * n""")
def fp_itemsets(spark, d):
    return rounded(A.fp_itemsets(_orders(spark, d).select("items"), 0.2, 2))


_ATTRS = """r AS (SELECT row_number() OVER () AS o, ['l_linestatus=' || l_linestatus, CASE WHEN l_linenumber = 1 THEN 'l_linenumber' ELSE 'l_linenumber=' || l_linenumber END, 'l_returnflag=' || l_returnflag] AS l FROM lineitem),
b AS (SELECT o, unnest(l) AS i FROM r), n AS (SELECT count(*) AS n FROM r),
f AS (SELECT [i] AS items, count(*) AS c FROM b GROUP BY i
  UNION ALL SELECT [x.i, y.i], count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY x.i, y.i
  UNION ALL SELECT [x.i, y.i, z.i], count(*) FROM b x JOIN b y ON x.o = y.o AND x.i < y.i JOIN b z ON z.o = x.o AND y.i < z.i GROUP BY x.i, y.i, z.i),
g AS (SELECT items, c / n AS s FROM f, n WHERE c >= 0.02 * n)"""
_RULES = f"""{_ATTRS}, p AS (
  SELECT items, s, [items[1]] AS a, items[2:] AS c FROM g WHERE len(items) > 1
  UNION ALL SELECT items, s, items[2:], [items[1]] FROM g WHERE len(items) > 1
  UNION ALL SELECT items, s, [items[2]], [items[1], items[3]] FROM g WHERE len(items) = 3
  UNION ALL SELECT items, s, [items[1], items[3]], [items[2]] FROM g WHERE len(items) = 3
  UNION ALL SELECT items, s, [items[3]], items[1:2] FROM g WHERE len(items) = 3
  UNION ALL SELECT items, s, items[1:2], [items[3]] FROM g WHERE len(items) = 3),
q AS (SELECT a AS antecedent, c AS consequent, p.s AS support, p.s / x.s AS confidence, p.s / x.s / y.s AS lift, x.s AS antecedent_support, y.s AS consequent_support
  FROM p JOIN g x ON x.items = a JOIN g y ON y.items = c WHERE p.s / x.s >= 0.1 - 1e-12 AND p.s / x.s / y.s >= 1 - 1e-12)"""


def _attributes(spark, d):
    return A.itemsets(A.baskets(table(spark, d, "lineitem"), ["l_linestatus", "l_linenumber", "l_returnflag"]), 0.02, 3)


@query(f"WITH {_RULES} SELECT antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(antecedent_support, 6) AS antecedent_support, round(consequent_support, 6) AS consequent_support FROM q")
def assoc_rules(spark, d):
    return rounded(A.rules(_attributes(spark, d), 0.1, 1.0))


@query(f"WITH {_RULES} SELECT round(coalesce(avg(lift), 0), 6) AS score FROM (SELECT lift FROM q ORDER BY lift DESC LIMIT 10)")
def assoc_score(spark, d):
    r = A.rules(_attributes(spark, d), 0.1, 1.0)
    return rounded(r.orderBy(F.col("lift").desc(), "antecedent", "consequent").limit(10).agg(F.coalesce(F.avg("lift"), F.lit(0.0)).alias("score")))


@query(f"WITH {_ATTRS} SELECT array_to_string(items, ' & ') AS itemset, CAST(len(items) AS INTEGER) AS length, printf('%.4f', CAST(round(CAST(s AS DECIMAL(18, 10)), 4) AS DOUBLE)) AS support FROM g WHERE len(items) >= 2")
def itemset_view(spark, d):
    m = A.Apriori()
    m.frequent_itemsets_ = _attributes(spark, d)
    m.rules_ = A.rules(m.frequent_itemsets_)
    return m.get_frequent_itemsets(2)
