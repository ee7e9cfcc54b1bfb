"""Connected components of an edge list by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import erase, written

#: Edges that one task joins by itself.
TASK_EDGES = 250_000


class Forest:
    """Trees of what has been joined, each named after its smallest member; beyond ``limit`` members ``trim`` starts anew."""

    def __init__(self, limit: int = 500_000):
        self.parent: dict = {}
        self.limit = limit

    def find(self, x):
        get = self.parent.get
        top = x
        while (up := get(top, top)) != top:
            top = up
        while (up := get(x, x)) != top:
            self.parent[x], x = top, up
        return top

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def trim(self) -> None:
        if len(self.parent) > self.limit:
            self.parent.clear()


def _stars(edges: DataFrame, tasks: int) -> DataFrame:
    """``node, to``: for each of ``tasks`` shares of the edges, the smallest node that its edges lead every other node to."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, types = Forest(), None
        for b in batches:
            types = b.schema.types
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                forest.join(x, y)
        if forest.parent:
            nodes = list({*forest.parent, *forest.parent.values()})
            yield pa.RecordBatch.from_arrays([pa.array(nodes, types[0]), pa.array([forest.find(x) for x in nodes], types[1])], ["node", "to"])

    return edges.repartition(tasks).mapInArrow(run, f"node {kind}, to {kind}")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: the smallest node reachable. Edges are undirected; nodes without edges don't appear.

    Each round, tasks of ``TASK_EDGES`` edges at most join what they hold; if that is one task, it has the components.
    Else every node goes to the first of itself and its neighbours, in a random order of that round, the edges are
    rewritten to where their ends went, and loops and repeats go, so that any graph loses a share of its nodes a round
    and the rounds grow with the logarithm of the edges. Where the nodes went is composed at the end. All is written
    every round. Joins go by node, where a hub is split by adaptive execution; sums are pre-aggregated.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    left = written(edges.where(F.col(a) != F.col(b)).select(*pair(F.col(a), F.col(b))).distinct(), "edges")
    went: list[DataFrame] = []
    while True:
        tasks = -(-left.count() // TASK_EDGES)
        stars = written(_stars(left, max(1, tasks)), "stars")
        erase(left)
        if tasks <= 1:
            went.append(stars)
            break
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(went))).alias("at"), F.col(c).alias("x"))
        both = stars.select("node", place("to").alias("to")).unionByName(stars.select(F.col("to").alias("node"), place("node").alias("to")))
        step = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least(place("node"), "to")["x"].alias("to"))
        went.append(written(step, "steps"))
        moved = stars.select(F.col("node").alias("a"), F.col("to").alias("b")).join(went[-1], F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        moved = moved.join(went[-1], F.col("b") == F.col("node")).select("a", F.col("to").alias("b"))
        left = written(moved.where("a <> b").select(*pair(F.col("a"), F.col("b"))).distinct(), "edges")
        erase(stars)
    if len(went) == 1:
        return went[0].select("node", F.col("to").alias("label"))
    out = went[-1].select("node", F.col("to").alias("root"))
    for step in reversed(went[:-1]):
        later = out.select(F.col("node").alias("to"), "root")
        out = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    out = written(out, "roots")
    # Firsts of a random order are not the smallest.
    labels = written(out.join(out.groupBy("root").agg(F.min("node").alias("label")), "root").select("node", "label"), "labels")
    erase(out, *went)
    return labels
