"""Metrics of predictions, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import distance


def accuracy(prediction: str = "prediction", label: str = "label") -> Column:
    return F.avg((F.col(prediction) == F.col(label)).cast("double"))


def mse(prediction: str = "prediction", label: str = "label") -> Column:
    d = F.col(label).cast("double") - F.col(prediction).cast("double")
    return F.avg(d * d)


def mae(prediction: str = "prediction", label: str = "label") -> Column:
    return F.avg(F.abs(F.col(label).cast("double") - F.col(prediction).cast("double")))


def r2(prediction: str = "prediction", label: str = "label", perfect_if_exact: bool = False) -> Column:
    """1 - residual over total; for a constant label 0, or 1 if exact and ``perfect_if_exact`` (linear models)."""
    d = F.col(label).cast("double") - F.col(prediction).cast("double")
    residual, total = F.sum(d * d), F.var_pop(F.col(label).cast("double")) * F.count(F.col(label))
    flat = F.when(residual == 0, 1.0).otherwise(0.0) if perfect_if_exact else F.lit(0.0)
    return F.when(total == 0, flat).otherwise(1 - residual / total)


def regression_metrics(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.agg(r2(prediction, label).alias("r2"), mse(prediction, label).alias("mse"), F.sqrt(mse(prediction, label)).alias("rmse"), mae(prediction, label).alias("mae"))


def class_metrics(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """``label, precision, recall, f1, support``; an undefined ratio is 0."""
    hit = F.col(prediction) == F.col(label)
    sides = df.select(F.inline(F.array(F.struct(F.col(label).alias("label"), F.lit(1).alias("true"), F.lit(0).alias("said"), hit.cast("int").alias("hit")), F.struct(F.col(prediction).alias("label"), F.lit(0).alias("true"), F.lit(1).alias("said"), F.lit(0).alias("hit")))))
    c = sides.groupBy("label").agg(F.sum("true").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return c.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def inertia(df: DataFrame, point: str, center: str) -> Column:
    d = distance(F.col(point), F.col(center))
    return F.sum(d * d)


#: Rows of a block of the silhouette, and the most partitions that its pairs of blocks are dealt over.
BLOCK_ROWS, MOST_PARTITIONS = 500, 2_000


def silhouette(df: DataFrame, key: str, point: str, label: str) -> DataFrame:
    """``silhouette`` of Euclidean distances over all pairs; -1 with fewer than two labels.

    All pairs are a quadratic cost. Each row meets every block of ``BLOCK_ROWS`` rows once, and what leaves a pair of
    blocks are sums by row and label.
    """
    rows = df.select(F.col(key).alias("k"), F.col(point).alias("v"), F.col(label).alias("l"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    own_block = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    n = min(blocks * blocks, MOST_PARTITIONS)
    a = rows.select(F.col("k").alias("ka"), F.col("v").alias("va"), F.col("l").alias("la"), own_block.alias("i"), every.alias("j")).repartition(n, "i", "j")
    b = rows.select("v", "l", own_block.alias("j"), every.alias("i")).repartition(n, "i", "j")
    per = a.join(b, ["i", "j"]).groupBy("ka", "la", "l").agg(F.sum(distance(F.col("va"), F.col("v"))).alias("s"), F.count("*").alias("n"))
    own = F.max(F.when(F.col("la") == F.col("l"), F.struct(F.col("s"), F.col("n"))))
    other = F.min(F.when(F.col("la") != F.col("l"), F.col("s") / F.col("n")))
    each = per.groupBy("ka").agg(own.alias("own"), other.alias("b"))
    inner = F.col("own.s") / (F.col("own.n") - 1)
    each = each.select(F.when(F.col("own.n") == 1, 0.0).otherwise((F.col("b") - inner) / F.greatest(F.col("b"), inner)).alias("s"), "b")
    return each.agg(F.coalesce(F.avg("s"), F.lit(-1.0)).alias("silhouette"))


def center_scores(df: DataFrame, point: str, label: str) -> DataFrame:
    """``calinski_harabasz, davies_bouldin`` from cluster means: two aggregations, no pairs of rows."""
    size = df.select(F.max(F.size(point))).head()[0]
    x = [F.col(point)[i].cast("double") for i in range(size)]
    means = df.groupBy(F.col(label).alias("l")).agg(F.array(*map(F.avg, x)).alias("c"), F.count("*").alias("n"))
    means_b = F.broadcast(means)
    d = distance(F.col(point), F.col("c"))
    within = df.join(means_b, F.col(label) == F.col("l")).groupBy("l").agg(F.avg(d).alias("s"), F.sum(d * d).alias("w"))
    stats = means.join(within, "l").collect()  # a row for each cluster
    total = df.agg(F.array(*map(F.avg, x))).head()[0]
    k, n = len(stats), sum(r["n"] for r in stats)
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    between, inside = sum(r["n"] * gap(r["c"], total) for r in stats), sum(r["w"] for r in stats)
    ch = between / (k - 1) / (inside / (n - k)) if k > 1 and n > k and inside else 0.0
    db = sum(max((a["s"] + b["s"]) / gap(a["c"], b["c"]) ** 0.5 for b in stats if b is not a and gap(a["c"], b["c"])) for a in stats) / k if k > 1 else 0.0
    return df.sparkSession.createDataFrame([(float(ch), float(db))], "calinski_harabasz double, davies_bouldin double")
