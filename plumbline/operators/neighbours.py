"""Nearest neighbours, density clusters, centroid steps.

Query rows meet training rows through a broadcast only while the query side is small (``BROADCAST_QUERIES`` rows of
``BROADCAST_BYTES`` in all); beyond that both sides are dealt into blocks of about ``BLOCK_ROWS`` rows, and pairs of
blocks are the groups of an equi-join, so that neither a task nor the number of tasks is fixed while the tables grow.
Range joins on few dimensions use grid cells and equi-joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.columns import col
from plumbline.functions.scalar import EPSILON, distance
from plumbline.operators import split

BROADCAST_QUERIES, BROADCAST_BYTES = 20_000, 64 << 20
BLOCK_ROWS = 5_000


def _meet(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """All pairs of a bounded query set (id, point) and the rows (id, point, ...); a larger one is dealt in blocks."""
    many, numbers = queries.agg(F.count("*"), F.sum(F.size(queries.columns[1]))).head()
    if many <= BROADCAST_QUERIES and 8 * (numbers or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(queries), F.lit(True))
    blocks = [-(-n // BLOCK_ROWS) for n in (many, max(1, rows.count()))]
    # Ids may repeat: the point has a say in the block, too.
    own = lambda df, n: F.pmod(F.xxhash64(*df.columns[:2]), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_i", own(queries, blocks[0])).withColumn("_j", every(blocks[1]))
    return rows.withColumn("_j", own(rows, blocks[1])).withColumn("_i", every(blocks[0])).join(q, ["_i", "_j"]).drop("_i", "_j")


def ordered_pairs(df: DataFrame, key: str, point: str) -> DataFrame:
    """``a, u, b, w``: all pairs of rows with a < b and their points, met in blocks as in nearest()."""
    q = df.select(col(key).alias("a"), col(point).alias("u"))
    t = df.select(col(key).alias("t_id"), col(point).alias("w"))
    return _meet(q, t).where("a < t_id").select("a", "u", F.col("t_id").alias("b"), "w")


def nearest(train: DataFrame, queries: DataFrame, k: int, key: str, point: str, metric: str = "euclidean", label: str | None = None, exclude_self: bool = False) -> DataFrame:
    """``q_id, t_id, distance, rank[, label]``: the k nearest, ties by id. A rank limit runs before the last shuffle."""
    t = train.select(col(key).alias("t_id"), col(point).alias("t_v"), *([col(label).alias("label")] if label else []))
    q = queries.select(col(key).alias("q_id"), col(point).alias("q_v"))
    pairs = _meet(q, t)
    pairs = pairs.where("q_id <> t_id") if exclude_self else pairs
    pairs = pairs.select("q_id", "t_id", distance(F.col("q_v"), F.col("t_v"), metric).alias("distance"), *(["label"] if label else []))
    w = Window.partitionBy("q_id").orderBy("distance", "t_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _weight(weights: str) -> Column:
    return F.lit(1.0) if weights == "uniform" else 1 / (F.col("distance") + EPSILON)


def knn_probabilities(near: DataFrame, weights: str = "uniform") -> DataFrame:
    """``q_id, label, probability``."""
    votes = near.groupBy("q_id", "label").agg(F.sum(_weight(weights)).alias("w"))
    return votes.select("q_id", "label", (F.col("w") / F.sum("w").over(Window.partitionBy("q_id"))).alias("probability"))


def knn_classify(near: DataFrame, weights: str = "uniform") -> DataFrame:
    """``q_id, prediction``: most weight, ties to the smallest label."""
    votes = near.groupBy("q_id", "label").agg(F.sum(_weight(weights)).alias("w"))
    return votes.groupBy("q_id").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("prediction"))


def knn_regress(near: DataFrame, weights: str = "uniform") -> DataFrame:
    w = _weight(weights)
    return near.groupBy("q_id").agg((F.sum(w * F.col("label").cast("double")) / F.sum(w)).alias("prediction"))


def assign(df: DataFrame, centers: list[list[float]], point: str, metric: str = "euclidean") -> DataFrame:
    """``df`` with ``cluster`` (nearest centre, the first of ties) and ``d2``: a projection over literal centres."""
    distances = F.array(*(distance(col(point), F.array(*map(F.lit, c)), metric) for c in centers))
    out = df.withColumn("_d", distances)
    least = F.array_min("_d")
    return out.withColumns({"cluster": (F.array_position("_d", least) - 1).cast("int"), "d2": least * least}).drop("_d")


def kmeans_step(df: DataFrame, centers: list[list[float]], point: str) -> DataFrame:
    """``cluster, n, center, inertia`` after one Lloyd step: partial sums, one small shuffle."""
    x = [F.avg(col(point)[i].cast("double")) for i in range(len(centers[0]))]
    return assign(df, centers, point).groupBy("cluster").agg(F.count("*").alias("n"), F.array(*x).alias("center"), F.sum("d2").alias("inertia"))


def _apart(left: str, right: str, width: int, metric: str) -> Column:
    """Distance of two points given as columns <prefix>0 and on: plain arithmetic, so that it is compiled."""
    gaps = [F.abs(F.col(f"{left}{i}") - F.col(f"{right}{i}")) for i in range(width)]
    if metric == "manhattan":
        return sum(gaps[1:], gaps[0])
    if metric != "euclidean":
        raise ValueError(f"cells need the euclidean or the manhattan distance, not {metric!r}; nearest() has others")
    squares = [g * g for g in gaps]
    return F.sqrt(sum(squares[1:], squares[0]))


def _points(df: DataFrame, key: str, axes: list[str]) -> DataFrame:
    return df.select(col(key).alias("id"), *(col(c).cast("double").alias(f"x{i}") for i, c in enumerate(axes))).dropna()


def _around(df: DataFrame, cells: list[str]) -> DataFrame:
    """Each row once for every cell that touches its own."""
    for c in cells:
        df = df.withColumn(c, F.explode(F.array(*(F.col(c) + d for d in (-1, 0, 1)))))
    return df


def _as(df: DataFrame, prefix: str, width: int, *more: str) -> DataFrame:
    return df.select(*(F.col(c) for c in df.columns if c.startswith("c")), F.col("id").alias(prefix), *(F.col(f"x{i}").alias(f"{prefix}_{i}") for i in range(width)), *more)


def within(df: DataFrame, key: str, axes: list[str], eps: float, metric: str = "euclidean") -> DataFrame:
    """``a, b`` with distance <= eps, each row with itself too: cells of side eps, an equi-join, an exact test.

    Only one side is spread over neighbour cells. For more than three axes the first three make the cells.
    """
    width, cells = len(axes), [f"c{i}" for i in range(min(3, len(axes)))]
    at = _points(df, key, axes).withColumns({c: F.floor(F.col(f"x{i}") / float(eps)).cast("long") for i, c in enumerate(cells)})
    met = _around(_as(at, "a", width), cells).join(_as(at, "b", width), cells)
    return met.where(_apart("a_", "b_", width, metric) <= eps).select("a", "b")


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder, where there is one; else keeps the plan."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a row number that stays: numbers are given by place, so they are written before they are joined on."""
    return _checkpoint(df.withColumn(name, F.monotonically_increasing_id()))


def _smallest(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``a, label``: the smallest node that links lead to, by smallest labels with pointer jumping, each round checkpointed."""
    links = links.select("a", "b")
    edges = _checkpoint(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(nodes.select("a", F.col("a").alias("b"))).distinct())
    labels = edges.groupBy("a").agg(F.min("b").alias("label"))
    while True:
        step = edges.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("label"))
        jump = step.select(F.col("a").alias("label"), F.col("label").alias("to"))
        new = _checkpoint(step.join(jump, "label").select("a", F.col("to").alias("label")))
        if new.join(labels.withColumnRenamed("label", "was"), "a").where("label <> was").isEmpty():
            return new
        labels = new


def dbscan(df: DataFrame, key: str, axes: list[str], eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """``id, is_core, cluster``: -1 is noise; clusters are numbered by their smallest core key, a border point
    belongs to the smallest cluster among its core neighbours.

    The cosine distance is half the squared Euclidean one of directions, which take the points' place; points of length
    zero have no direction and are noise. Cells are so small that the points of one are all neighbours: a cell of ``min_samples`` points has core points only, and
    the core points of a cell are one cluster. So neighbours are counted for points of thinner cells alone, and
    clusters are components of cells. Neighbouring cells are linked by the outermost core points of either, first; their
    points meet only where these do not reach and no other cells link the two. Pairs of points are never written.
    """
    width = len(axes)
    points = _points(df, key, axes)
    if metric == "cosine":
        length = F.sqrt(sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(width)), F.lit(0.0)))
        points = points.withColumn("length", length).where("length > 0").select("id", *((F.col(f"x{i}") / F.col("length")).alias(f"x{i}") for i in range(width)))
        metric, eps = "euclidean", math.sqrt(2 * eps)
    side = float(eps) / (math.sqrt(width) if metric == "euclidean" else width) * (1 - 1e-9)
    wide = math.ceil(float(eps) / side)
    cells = [f"c{i}" for i in range(min(3, width))]  # of side eps at least: neighbours are in the same or a touching one
    at = points.withColumn("cell", F.array(*(F.floor(F.col(f"x{i}") / side).cast("long") for i in range(width))))
    at = at.withColumns({c: F.floor(F.col("cell")[i] / wide).cast("long") for i, c in enumerate(cells)})
    at = _checkpoint(at.join(at.groupBy("cell").agg(F.count("*").alias("held")), "cell"))
    near = lambda met: met.where(_apart("a_", "b_", width, metric) <= eps)

    thin = _around(_as(at.where(F.col("held") < min_samples), "a", width), cells).drop("cell")
    found = near(thin.join(_as(at.drop("cell"), "b", width), cells)).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples)
    core_ids = at.where(F.col("held") >= min_samples).select("id").unionByName(found.select(F.col("a").alias("id")))
    core = _checkpoint(at.join(core_ids, "id", "left_semi"))

    point = F.array(*(F.col(f"x{i}") for i in range(width)))
    ends = F.array(*(f(point, F.col(f"x{i}")) for i in range(width) for f in (F.min_by, F.max_by)))
    held = _checkpoint(core.groupBy("cell", *cells).agg(F.min("id").alias("a"), ends.alias("ends")))
    other = held.select(*cells, F.col("a").alias("b"), F.col("cell").alias("there"), F.col("ends").alias("far_ends"))
    steps = [F.greatest(F.abs(F.col("cell")[i] - F.col("there")[i]) - 1, F.lit(0)).cast("double") for i in range(width)]
    least = sum(steps[1:], steps[0]) if metric == "manhattan" else F.sqrt(sum((x * x for x in steps[1:]), steps[0] * steps[0]))
    reach = F.exists("ends", lambda p: F.exists("far_ends", lambda q: distance(p, q, metric) <= eps))
    pairs = _around(held, cells).join(other, cells).where((F.col("a") < F.col("b")) & (least * side <= eps))
    pairs = _checkpoint(pairs.select("a", "b", "cell", "there", reach.alias("linked")))
    links = pairs.where("linked").select("a", "b")
    labels = _smallest(held, links)
    apart = pairs.where("NOT linked").join(labels.withColumnRenamed("label", "la"), "a").join(labels.select(F.col("a").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
    members = core.select("cell", "id", *(f"x{i}" for i in range(width)))
    one = members.select("cell", *(F.col(f"x{i}").alias(f"a_{i}") for i in range(width)))
    two = members.select(F.col("cell").alias("there"), *(F.col(f"x{i}").alias(f"b_{i}") for i in range(width)))
    more = near(apart.select("cell", "there", "a", "b").join(one, "cell").join(two, "there")).select("a", "b").distinct()
    labels = _smallest(held, links.unionByName(more))

    roots = labels.select("label").distinct()
    number = split.positions(roots, [], "label", None).select("label", F.col("_at").alias("cluster"))
    named = _checkpoint(core.join(held.select("cell", "a").join(labels, "a").join(number, "label").select("cell", "cluster"), "cell"))
    rest = at.join(named.select("id"), "id", "left_anti").drop("cell")
    border = near(_around(_as(rest, "a", width), cells).join(_as(named.drop("cell"), "b", width, "cluster"), cells)).groupBy("a").agg(F.min("cluster").alias("border"))
    every = df.select(col(key).alias("id"))
    return every.join(named.select("id", "cluster"), "id", "left").join(border.withColumnRenamed("a", "id"), "id", "left").select(
        "id", F.col("cluster").isNotNull().alias("is_core"), F.coalesce("cluster", "border", F.lit(-1)).cast("int").alias("cluster")
    )


def dbscan_predict(fitted: DataFrame, df: DataFrame, queries: DataFrame, key: str, axes: list[str], eps: float, metric: str = "euclidean") -> DataFrame:
    """``q_id, cluster`` of the nearest core point within eps, else -1, by the fitted metric."""
    vec = F.array(*(col(c).cast("double") for c in axes))
    cores = df.withColumn("_v", vec).join(fitted.where("is_core").select(F.col("id").alias(key), "cluster"), key)
    near = nearest(cores, queries.withColumn("_v", vec), 1, key, "_v", metric, "cluster")
    all_q = queries.select(col(key).alias("q_id"))
    return all_q.join(near.where(F.col("distance") <= eps), "q_id", "left").select("q_id", F.coalesce("label", F.lit(-1)).cast("int").alias("cluster"))

