"""Exact top-k inner-product search by bit-sliced indexes.

Components become integers floor(256 * x). A block of vectors is indexed as bit slices: for each component, bitmap b
holds bit b of its value (above the block's minimum, without its ``DROPPED_BITS`` lowest bits) over all rows of the block. A query
adds the slices of all components, weighted by its own integers, with carry-save bitmap adders; negative weights
add complemented slices. The sum is again bit-sliced: its k largest rows are found from the most significant slice
downward. Dropped bits bound the true score on both sides, so every row that could belong to the k best is
selected too, again slice by slice, and such boundary rows are resolved by their exact scores.

A stated query set meets all rows in blocks: ``(block of rows, block of queries)`` pairs of fixed size are the
groups, each builds its index and returns k rows a query at most; the k best of those are the answer.

Defined results: vectors that are null, or hold null or non-finite components, take no part, neither as query nor as
candidate; a candidate with the query's own id is left out; vectors of another length than the query's
have no score with it; ties of score go to the smaller id, equal rows (same id and score) count once each; empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table

DROPPED_BITS = 3
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 1_024


class BitSlicedIndex:
    """Bitmaps are Python integers: bit r is row r."""

    def __init__(self, values: np.ndarray, dropped: int = DROPPED_BITS):
        self.values, self.dropped = values.astype(np.int64), dropped
        self.rows = len(values)
        self.all = (1 << self.rows) - 1
        self.low = self.values.min(axis=0) if self.rows else np.zeros(values.shape[1], np.int64)
        kept = (self.values - self.low) >> dropped
        self.bits = [int(kept[:, d].max(initial=0)).bit_length() for d in range(kept.shape[1])]
        self.slices = [[self._bitmap((kept[:, d] >> b) & 1) for b in range(n)] for d, n in enumerate(self.bits)]

    def _bitmap(self, bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), "little")

    def _rows(self, bitmap: int) -> np.ndarray:
        data = np.frombuffer(bitmap.to_bytes((self.rows + 7) // 8, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(data, count=self.rows, bitorder="little"))

    def add(self, weights: list[int]) -> list[int]:
        """Slices of the sum over components of |weight| * (value or, for a negative weight, its complement)."""
        columns: list[list[int]] = []
        for d, w in enumerate(weights):
            own, flip = abs(w), self.all if w < 0 else 0
            bitmaps = [s ^ flip for s in self.slices[d]]
            p = 0
            while own:
                if own & 1:
                    while len(columns) < p + len(bitmaps):
                        columns.append([])
                    for b, s in enumerate(bitmaps):
                        columns[p + b].append(s)
                own >>= 1
                p += 1
        out = []
        p = 0
        while p < len(columns):
            column = columns[p]
            if len(column) > 1 and p + 1 == len(columns):
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                x = a ^ b
                column.insert(0, x ^ c)
                columns[p + 1].append((a & b) | (x & c))
            if len(column) == 2:
                a, b = column
                columns[p + 1].append(a & b)
                column = [a ^ b]
            out.append(column[0] if column else 0)
            p += 1
        return out

    def largest(self, slices: list[int], k: int, among: int) -> int:
        """The k-th largest sum among the rows of ``among`` (which has k rows at least), most significant slice first."""
        value, sure, tied = 0, 0, among
        for p in range(len(slices) - 1, -1, -1):
            with_bit = tied & slices[p]
            if sure + (n := with_bit.bit_count()) >= k:
                tied, value = with_bit, value | 1 << p
            else:
                sure, tied = sure + n, tied & ~slices[p]
        return value

    def at_least(self, slices: list[int], value: int, among: int) -> int:
        if value <= 0:
            return among
        if value.bit_length() > len(slices):
            return 0
        above, equal = 0, among
        for p in range(len(slices) - 1, -1, -1):
            if value >> p & 1:
                equal &= slices[p]
            else:
                above |= equal & slices[p]
                equal &= ~slices[p]
        return above | equal

    def top(self, query: np.ndarray, k: int, without: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of all rows that may be among the k best by score, ties included."""
        among = self.all & ~without
        n = among.bit_count()
        if n > k:
            weights = query.tolist()
            slices = self.add(weights)
            # score = constant + 2^dropped * sum + rest, where the rest lies between what negative and positive weights add.
            span = ((1 << self.dropped) - 1) * int(np.abs(query).sum())
            slack = (span + (1 << self.dropped) - 1) >> self.dropped
            among = self.at_least(slices, self.largest(slices, k, among) - slack, among)
        rows = self._rows(among)
        return rows, self.values[rows] @ query


_FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, v``: integer components of the vectors that take part."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return (
        vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        .where(~F.coalesce(bad, F.lit(True)))
        .select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))
    )


def top_k(queries: DataFrame, rows: DataFrame, k: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of each query; both sides have ``id, v``."""

    def best(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        ids, sizes = left["id"].to_numpy(), left["v"].map(len).to_numpy()
        for size, some in right.groupby(right["v"].map(len)):
            at = np.flatnonzero(sizes == size)
            if not len(at) or not size:
                continue
            index, own = BitSlicedIndex(np.stack(left["v"].iloc[at].to_list())), ids[at]
            where: dict[int, int] = {}
            for r, i in enumerate(own.tolist()):
                where[i] = where.get(i, 0) | 1 << r
            for q, v in zip(some["id"].tolist(), some["v"], strict=True):
                found, scores = index.top(np.asarray(v, np.int64), k, where.get(q, 0))
                pick = np.lexsort((own[found], -scores))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": own[found][pick], "score": scores[pick]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query_id", "vec_id", "score")})

    queries = queries.distinct()
    n_rows = max(1, -(-rows.count() // block_rows))
    n_queries = max(1, -(-queries.count() // block_queries))
    # Rows of one id are dealt by position, so that repeated ids don't meet in one block.
    left = rows.withColumn("b", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_rows))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    right = queries.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
    near = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(best, _FOUND)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows.where("id % 50 = 0"), rows, 5)


OP7_SQL = """
WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM u q JOIN u c ON q.d = c.d AND q.id <> c.id WHERE q.id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
