"""Profile of a table in long form, correlation pairs, quality score.

Numbers of all columns come from one aggregation; distinct counts, modes and value counts from one grouping of
(column, value) pairs, which combines before its shuffle, instead of an expansion for each distinct count.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.columns import categorical, col, numeric

#: Columns in one aggregation: keeps generated code within the JVM's limits.
WIDTH = 60


def quantile(c: Column, p: float | list[float], accuracy: int | None = None) -> Column:
    """Linearly interpolated and exact; with ``accuracy`` approximate, for columns of very many distinct values."""
    probs = F.lit(p) if isinstance(p, float) else F.array(*map(F.lit, p))
    return F.percentile_approx(c, probs, accuracy) if accuracy else F.percentile(c, probs)


def _long(df: DataFrame, rows: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """One row per column with named metrics, from one aggregation of ``df`` per ``WIDTH`` columns."""
    out = []
    for at in range(0, len(rows), WIDTH):
        part = rows[at : at + WIDTH]
        one = df.agg(*(F.struct(F.lit(n).alias("column"), *(e.alias(k) for k, e in m.items())).alias(f"c{i}") for i, (n, m) in enumerate(part)))
        out.append(one.select(F.inline(F.array(*(f"c{i}" for i in range(len(part)))))))
    return reduce(DataFrame.unionByName, out)


def numeric_profile(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """``column, count, missing, min, max, mean, std, variance, q1, median, q3`` of numeric columns."""
    rows = []
    for n in columns or numeric(df):
        c = col(n).cast("double")
        q = quantile(c, [0.25, 0.5, 0.75], accuracy)
        rows.append((n, {"count": F.count(c), "missing": F.count_if(c.isNull()), "min": F.min(c), "max": F.max(c), "mean": F.avg(c), "std": F.stddev_samp(c), "variance": F.var_samp(c), "q": q}))
    return _long(df, rows).select("column", "count", "missing", "min", "max", "mean", "std", "variance", *(F.col("q")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))))


def missing(df: DataFrame) -> DataFrame:
    """``column, missing, percent`` of all rows."""
    return _long(df, [(n, {"missing": F.count_if(col(n).isNull()), "percent": F.count_if(col(n).isNull()) * 100.0 / F.count("*")}) for n in df.columns])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n`` (value as text, nulls left out): one scan, one shuffle."""
    pairs = F.array(*(F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value")) for n in columns))
    return df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """``column, rank, value, n``: by falling count, ties by value."""
    w = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column", "rank", "value", "n")


def categorical_profile(df: DataFrame, columns: list[str] | None = None, likely_below: int = 20) -> DataFrame:
    """``column, distinct, top, freq, support, likely_categorical``: mode by smallest tie, support of all rows."""
    columns = columns or categorical(df)
    counts = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("distinct"), F.max(F.col("n")).alias("freq"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"))
    rows = df.agg(F.count("*").alias("rows"))
    return counts.join(F.broadcast(rows)).select("column", "distinct", "top", "freq", (F.col("freq") / F.col("rows")).alias("support"), (F.col("distinct") < likely_below).alias("likely_categorical"))


def sample_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """``column, rank, value``: the k smallest distinct values as text."""
    w = Window.partitionBy("column").orderBy("value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("column", "rank", "value")


def bounds(df: DataFrame, columns: list[str], fold: float = 1.5, method: str = "iqr", accuracy: int | None = None) -> dict[str, tuple[float, float] | None]:
    """Lower and upper limit of each column: quartiles (iqr), mean (gaussian), median deviation (mad) or quantiles."""
    q = {"iqr": [0.25, 0.75], "quantiles": [0.05, 0.95], "mad": [0.5]}
    if method not in (*q, "gaussian"):
        raise ValueError(f"unknown capping method {method!r}")
    if method == "gaussian":
        got = df.agg(*(F.array(F.avg(col(c).cast("double")), F.stddev_samp(col(c).cast("double"))).alias(f"x{i}") for i, c in enumerate(columns))).head()
    else:
        got = df.agg(*(quantile(col(c).cast("double"), q[method], accuracy).alias(f"x{i}") for i, c in enumerate(columns))).head()
    if method == "mad":
        mids = [x[0] if x else None for x in got]
        spread = df.agg(*(quantile(F.abs(col(c).cast("double") - F.lit(m)), [0.5], accuracy).alias(f"x{i}") for i, (c, m) in enumerate(zip(columns, mids, strict=True)))).head()
        got = [(m, 1.4826 * s[0]) if s else None for m, s in zip(mids, spread, strict=True)]
    out = {}
    for c, x in zip(columns, got, strict=True):
        if not x or x[0] is None or x[1] is None:
            out[c] = None
        elif method == "iqr":
            out[c] = x[0] - fold * (x[1] - x[0]), x[1] + fold * (x[1] - x[0])
        elif method == "quantiles":
            out[c] = x[0], x[1]
        else:
            out[c] = x[0] - fold * x[1], x[0] + fold * x[1]
    return out


def outliers(df: DataFrame, columns: list[str] | None = None, fold: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """``column, lower, upper, outliers``: values beyond the quartile limits; 0 where a column has no values."""
    columns = columns or numeric(df)
    limits = bounds(df, columns, fold, accuracy=accuracy)
    rows = []
    for c in columns:
        lo, hi = limits[c] or (None, None)
        out = F.count_if((col(c) < F.lit(lo)) | (col(c) > F.lit(hi))) if limits[c] else F.lit(0).cast("long")
        rows.append((c, {"lower": F.lit(lo).cast("double"), "upper": F.lit(hi).cast("double"), "outliers": out}))
    return _long(df, rows)


def variation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, cv``: standard deviation over mean, for means other than 0."""
    rows = [(c, {"mean": F.avg(col(c)), "std": F.stddev_samp(col(c))}) for c in columns or numeric(df)]
    return _long(df, rows).where("mean <> 0").select("column", (F.col("std") / F.col("mean")).alias("cv"))


def correlations(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """``a, b, r`` for pairs of columns with |r| above the threshold; pairwise complete rows."""
    pairs = list(combinations(columns or numeric(df), 2))
    rows = [(f"{i}", {"a": F.lit(a), "b": F.lit(b), "r": F.corr(col(a).cast("double"), col(b).cast("double"))}) for i, (a, b) in enumerate(pairs)]
    return _long(df, rows).where(F.abs("r") > threshold).select("a", "b", "r")


def quality_score(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """``rows, columns, completeness, penalty, score``: completeness less a penalty for outlying cells, 0 to 100.

    ``accuracy`` makes the quartiles approximate, for columns of very many distinct values.
    """
    cells = missing(df).agg(F.avg("percent").alias("p"))
    out = outliers(df, accuracy=accuracy).agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("o")) if numeric(df) else cells.select(F.lit(0).alias("o"))
    rows = df.agg(F.count("*").alias("rows"))
    done = F.greatest(F.lit(0.0), 100 - F.col("p"))
    penalty = F.least(F.lit(50.0), F.col("o") * 100.0 / F.greatest(F.col("rows"), F.lit(1)))
    one = cells.join(out).join(rows)
    return one.select(
        "rows",
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.round(done, 2).alias("completeness"),
        F.round(penalty, 2).alias("penalty"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), done - penalty)), 2).alias("score"),
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.where(col(label).isNotNull()).groupBy(col(label).alias("label")).agg(F.count("*").alias("n"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    return class_distribution(df, label).agg(F.count("*").alias("classes"), (F.max("n") / F.min("n")).alias("ratio"))


def target_stats(df: DataFrame, target: str) -> DataFrame:
    c = col(target).cast("double")
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def cell_variance(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``variance`` over all cells, ``mean_std`` of columns (population), from sums of one pass."""
    columns = columns or numeric(df)
    n, s, q = (reduce(Column.__add__, [f(col(c).cast("double")) for c in columns]) for f in (F.count, F.sum, lambda c: F.sum(c * c)))
    mean_std = reduce(Column.__add__, [F.stddev_pop(col(c).cast("double")) for c in columns]) / len(columns)
    return df.agg((q / n - (s / n) * (s / n)).alias("variance"), mean_std.alias("mean_std"))


def association_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """``rows, total_items, mean_items``: distinct values, summed and averaged over columns."""
    per = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("total_items"))
    return df.agg(F.count("*").alias("rows")).join(per).select("rows", "total_items", (F.col("total_items") / len(columns)).alias("mean_items"))


def summary(df: DataFrame, sample: int = 5) -> dict:
    """The driver-side summary: rows, columns and per-column facts."""
    facts = {r["column"]: r.asDict() for r in missing(df).collect()}
    for part in (numeric_profile(df) if numeric(df) else None, categorical_profile(df, df.columns)):
        for r in part.collect() if part is not None else []:
            facts[r["column"]].update(r.asDict())
    for r in sample_values(df, df.columns, sample).collect():
        facts[r["column"]].setdefault("samples", []).append(r["value"])
    types = dict(df.dtypes)
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return {"rows": df.count(), "columns_count": len(df.columns), "columns": {n: {**facts[n], "dtype": types[n]} for n in df.columns}, "memory_usage_mb": int(str(size)) / 1e6}
