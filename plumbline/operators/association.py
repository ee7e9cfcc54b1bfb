"""Frequent itemsets and association rules.

Baskets are an array column. ``itemsets`` counts equal baskets once, cuts them to frequent items and, where that leaves
few subsets of up to ``max_length`` items, counts these as they come out of each row, with map-side combine;
otherwise, and without a bound, it uses ``fp_itemsets``, the parallel FP-growth of the ML library. Both are exact. Rules
come from every split of each itemset, their supports from joins on the itemset.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import col, numeric
from plumbline.functions.scalar import fixed, item, shown

#: Frequent items that ``itemsets`` takes into its plan, and subsets of a row that it makes, at most.
FREQUENT_ITEMS, ROW_SUBSETS = 1_000, 5_000


def baskets(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``items`` of each row (see ``scalar.item``); rows without items are dropped."""
    columns = columns or df.columns
    numbers = set(numeric(df))
    items = F.array_compact(F.array(*(item(c, col(c), c in numbers) for c in columns)))
    return df.select(F.array_sort(F.array_distinct(items)).alias("items")).where(F.size("items") > 0)


def list_baskets(df: DataFrame, column: str) -> DataFrame:
    """Rows of values as baskets: null, empty and 0 left out."""
    text = F.transform(col(column), lambda x: x.cast("string"))
    kept = F.filter(text, lambda x: x.isNotNull() & ~x.isin("", "0", "0.0", "false"))
    return df.select(F.array_sort(F.array_distinct(kept)).alias("items")).where(F.size("items") > 0)


def itemsets(b: DataFrame, min_support: float = 0.1, max_length: int | None = None) -> DataFrame:
    """``items, freq, support`` of all itemsets with at least the support, of at most ``max_length`` items."""
    n = b.count()
    least = min_support * n - 1e-9
    single = b.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)
    frequent = [r[0] for r in single.select("item").limit(FREQUENT_ITEMS + 1).collect()] if max_length else []
    if max_length is None or len(frequent) > FREQUENT_ITEMS:
        return fp_itemsets(b, min_support, max_length)
    if not n or not frequent or max_length < 1:
        return b.sparkSession.createDataFrame([], "items array<string>, freq long, support double")
    pruned = b.select(F.array_sort(F.array_distinct(F.array_intersect("items", F.array(*map(F.lit, sorted(frequent)))))).alias("items"))
    # Subsets of a basket of m items: the sum of the binomials up to max_length.
    binomial, subsets = F.lit(1.0), F.lit(0.0)
    for k in range(1, max_length + 1):
        binomial = binomial * F.greatest(F.size("items") - (k - 1), F.lit(0)) / k
        subsets = subsets + binomial
    most = pruned.agg(F.max(subsets)).head()[0] or 0
    if most > ROW_SUBSETS:
        return fp_itemsets(b, min_support, max_length)
    alike = pruned.where(F.size("items") > 0).groupBy("items").agg(F.count("*").alias("freq"))
    none = F.array(F.array().cast("array<string>"))
    grown = F.aggregate("items", none, lambda made, x: F.concat(made, F.transform(F.filter(made, lambda s: F.size(s) < max_length), lambda s: F.concat(s, F.array(x)))))
    found = alike.select(F.explode(F.filter(grown, lambda s: F.size(s) > 0)).alias("items"), "freq").groupBy("items").agg(F.sum("freq").alias("freq"))
    return found.where(F.col("freq") >= least).withColumn("support", F.col("freq") / n)


def fp_itemsets(b: DataFrame, min_support: float = 0.1, max_length: int | None = None) -> DataFrame:
    from pyspark.ml.fpm import FPGrowth

    n = b.count()
    least = max(1, math.ceil(min_support * n - 1e-9))
    # Half a row below the least count, so that rounding of the product does not move it.
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(1, n)).fit(b).freqItemsets
    found = found.where(F.size("items") <= max_length) if max_length else found
    return found.select(F.array_sort("items").alias("items"), "freq", (F.col("freq") / n).alias("support"))


def rules(sets: DataFrame, min_confidence: float = 0.5, min_lift: float = 1.0) -> DataFrame:
    """All splits of each itemset: ``antecedent, consequent, support, confidence, lift`` and both sides' supports.

    Splits are bit masks, made in two halves so that no row holds them all; sets of more than 62 items raise.
    """
    size = F.size("items")
    checked = F.when(size > 62, F.raise_error(F.lit("an itemset of more than 62 items")).cast("int")).otherwise(size)
    many = sets.where(size >= 2).select("items", "support", checked.alias("k"))
    many = many.withColumn("high", F.explode(F.expr("sequence(0L, shiftleft(1L, greatest(k - 12, 0)) - 1)")))
    many = many.withColumn("low", F.explode(F.expr("sequence(0L, shiftleft(1L, least(k, 12)) - 1)")))
    mask = F.shiftleft("high", 12) + F.col("low")
    splits = many.withColumn("mask", mask).where("mask > 0 AND mask < shiftleft(1L, k) - 1").select("items", "support", "mask")
    part = lambda bit: F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {bit})")
    s = splits.select(part(1).alias("antecedent"), part(0).alias("consequent"), "support")
    known = sets.select("items", F.col("support").alias("own"))
    s = s.join(known.select(F.col("items").alias("antecedent"), F.col("own").alias("antecedent_support")), "antecedent")
    s = s.join(known.select(F.col("items").alias("consequent"), F.col("own").alias("consequent_support")), "consequent")
    confidence = F.col("support") / F.col("antecedent_support")
    s = s.select("antecedent", "consequent", "support", confidence.alias("confidence"), (confidence / F.col("consequent_support")).alias("lift"), "antecedent_support", "consequent_support")
    return s.where((F.col("confidence") >= min_confidence - 1e-12) & (F.col("lift") >= min_lift - 1e-12))


class Apriori:
    """``fit(df)`` on a table (or ``fit_baskets``), then itemsets, rules, score, save and load."""

    def __init__(self, min_support: float = 0.1, min_confidence: float = 0.5, min_lift: float = 1.0, max_length: int | None = None):
        self.min_support, self.min_confidence, self.min_lift, self.max_length = min_support, min_confidence, min_lift, max_length
        self.frequent_itemsets_: DataFrame | None = None
        self.rules_: DataFrame | None = None

    def get_params(self) -> dict:
        return {k: getattr(self, k) for k in ("min_support", "min_confidence", "min_lift", "max_length")}

    def set_params(self, **params) -> Apriori:
        for k, v in params.items():
            if k not in self.get_params():
                raise ValueError(f"unknown parameter {k!r}")
            setattr(self, k, v)
        return self

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> Apriori:
        return self.fit_baskets(baskets(df, columns))

    def fit_baskets(self, b: DataFrame) -> Apriori:
        self.frequent_itemsets_ = itemsets(b, self.min_support, self.max_length).persist()
        self.rules_ = rules(self.frequent_itemsets_, self.min_confidence, self.min_lift)
        return self

    def _fitted(self) -> None:
        if self.rules_ is None:
            raise RuntimeError("fit first")

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError("association rules predict nothing")

    def get_rules(self, top_n: int | None = None) -> DataFrame:
        """Sides as text, numbers with four places, by falling lift and then by sides."""
        self._fitted()
        r = self.rules_.select(shown(F.col("antecedent")).alias("antecedent"), shown(F.col("consequent")).alias("consequent"), "support", "confidence", "lift")
        r = r.orderBy(F.col("lift").desc(), "antecedent", "consequent")
        r = r.limit(top_n) if top_n is not None else r
        return r.select("antecedent", "consequent", *(fixed(F.col(c)).alias(c) for c in ("support", "confidence", "lift")))

    def get_frequent_itemsets(self, min_length: int = 1) -> DataFrame:
        self._fitted()
        s = self.frequent_itemsets_.where(F.size("items") >= min_length)
        return s.orderBy(F.col("support").desc(), "items").select(shown(F.col("items")).alias("itemset"), F.size("items").alias("length"), fixed(F.col("support")).alias("support"))

    def score(self) -> float:
        """Mean lift of the ten best rules, 0 without rules."""
        self._fitted()
        best = self.rules_.orderBy(F.col("lift").desc(), "antecedent", "consequent").limit(10)
        return best.agg(F.coalesce(F.avg("lift"), F.lit(0.0))).head()[0]

    def save(self, path: str) -> None:
        self._fitted()
        self.frequent_itemsets_.write.mode("overwrite").parquet(f"{path}/itemsets")
        self.frequent_itemsets_.sparkSession.createDataFrame([(json.dumps(self.get_params()),)], "params string").coalesce(1).write.mode("overwrite").json(f"{path}/params")

    @classmethod
    def load(cls, spark, path: str) -> Apriori:
        out = cls(**json.loads(spark.read.schema("params string").json(f"{path}/params").head()[0]))
        out.frequent_itemsets_ = spark.read.parquet(f"{path}/itemsets")
        out.rules_ = rules(out.frequent_itemsets_, out.min_confidence, out.min_lift)
        return out
