"""Splits and folds by key: repeatable on any partitioning, no sampling by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from plumbline.columns import col


def _order(key: str, seed: int) -> Column:
    return F.xxhash64(col(key), F.lit(seed))


def train_test(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hash split: no shuffle, rows of one key stay together."""
    part = F.pmod(_order(key, seed), F.lit(10_000))
    cut = round(10_000 * test_size)
    return df.where(part >= cut), df.where(part < cut)


#: Blocks of the order that a stratum is ranked in: powers of two for hashes, quantiles for numeric keys.
HASH_BITS, KEY_BLOCKS = 10, 64


def positions(df: DataFrame, strata: list[str], key: str, seed: int | None) -> DataFrame:
    """``df`` with position ``_at`` (from 0) and size ``_of`` in the stratum, by hash and key, or by the key itself without a seed.

    Rows are ranked inside a block of the order, whose offset is the running count of the blocks before it, so that no
    task holds a whole stratum. Keys that are neither numbers nor hashed are ranked in one window a stratum.
    """
    keys = strata or ["_all"]
    rows = df if strata else df.withColumn("_all", F.lit(0))
    order = [col(key)] if seed is None else [_order(key, seed), col(key)]
    if seed is not None:
        block = F.shiftright(_order(key, seed), 64 - HASH_BITS)
    elif isinstance(df.schema[key].dataType, NumericType):
        shares = F.array(*(F.lit(i / KEY_BLOCKS) for i in range(1, KEY_BLOCKS)))
        cuts = sorted(set(df.agg(F.percentile_approx(col(key), shares, 1_000)).head()[0] or []))
        block = F.when(col(key).isNull(), -1)
        for i, c in enumerate(cuts):
            block = block.when(col(key) <= F.lit(c), i)
        block = block.otherwise(len(cuts))
    else:
        block = F.lit(0)
    rows = rows.withColumn("_block", block.cast("long"))
    held = rows.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_of"))
    on = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    placed = rows.join(offsets, on).withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1 + F.col("_offset"))
    return placed.select(*(col(c) for c in df.columns), "_at", "_of")


def stratified(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int | None = 42) -> DataFrame:
    """``df`` with boolean ``is_test``: the first share of each class by hash (by key itself for ``seed=None``)."""
    return positions(df, [label], key, seed).withColumn("is_test", F.col("_at") < F.floor(F.col("_of") * test_size)).drop("_at", "_of")


def folds(df: DataFrame, k: int, key: str, label: str | None = None, seed: int | None = 42) -> DataFrame:
    """``df`` with ``fold``: position modulo k, inside each class if ``label`` is given; without one, by hash alone."""
    if label is None and seed is not None:
        return df.withColumn("fold", F.pmod(_order(key, seed), F.lit(k)).cast("int"))
    return positions(df, [label] if label else [], key, seed).withColumn("fold", (F.col("_at") % k).cast("int")).drop("_at", "_of")


def rest(df: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't in ``part``."""
    return df.join(part.select(col(key)), key, "left_anti")
