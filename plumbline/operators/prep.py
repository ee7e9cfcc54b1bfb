"""Preprocessing: each ``fit_*`` learns from training rows and gives a ``Fitted`` stage, which is a pure projection.

A fitted stage holds its numbers as JSON, so it can be saved and replayed on any batch or stream. Values learned for
a column apply to every later batch, whether or not the column had nulls in training; unseen categories are
all-zero (one-hot) or null (frequency, label).
"""

from __future__ import annotations

import json
import uuid
import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.columns import categorical, col, numeric
from plumbline.functions.expressions import derive
from plumbline.functions.scalar import clamp, shifted_log, yeo_johnson
from plumbline.operators import profile

_APPLY: dict[str, Callable[..., DataFrame]] = {}
#: Categories that fitted stages take into their plan: one-hot columns a column, numbers of a value map.
ONEHOT_UP_TO, MAP_UP_TO = 1_000, 5_000


@dataclass(frozen=True)
class Fitted:
    kind: str
    params: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return _APPLY[self.kind](df, **self.params)

    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "params": self.params})

    @staticmethod
    def from_json(text: str) -> Fitted:
        return Fitted(**json.loads(text))


def _stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    _APPLY[f.__name__.lstrip("_")] = f
    return f


def _replace(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """One projection with new expressions for existing columns."""
    return df.select(*(made[c].alias(c) if c in made else col(c) for c in df.columns)) if made else df


def _have(df: DataFrame, values: dict) -> dict:
    return {c: v for c, v in values.items() if c in df.columns}


def _row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Values of one aggregation by column."""
    got = df.agg(*(e.alias(f"x{i}") for i, e in enumerate(exprs.values()))).head() if exprs else ()
    return dict(zip(exprs, got, strict=True))


# --- rows and targets


@_stage
def _drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(col(c) for c in df.columns if c not in columns))


@_stage
def _drop_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=[c for c in columns if c in df.columns])


@_stage
def _numeric_target(df: DataFrame, target: str) -> DataFrame:
    out = _replace(df, {target: col(target).try_cast("double")})
    return out.where(col(target).isNotNull())


@_stage
def _label_encode(df: DataFrame, target: str, labels: list[str], strict: bool = True) -> DataFrame:
    codes = F.create_map(*(x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i)))) if labels else None
    code = F.try_element_at(codes, col(target)) if labels else F.lit(None).cast("int")
    if strict:
        code = F.when(col(target).isNotNull() & code.isNull(), F.raise_error(F.concat(F.lit("unseen label "), col(target))).cast("int")).otherwise(code)
    return _replace(df, {target: code})


def fit_label_encode(df: DataFrame, target: str, strict: bool = True) -> Fitted:
    labels = [r[0] for r in df.select(col(target)).where(col(target).isNotNull()).distinct().orderBy(col(target)).collect()]
    return Fitted("label_encode", {"target": target, "labels": labels, "strict": strict})


def inverse_label(df: DataFrame, fitted: Fitted, column: str) -> DataFrame:
    labels = F.array(*map(F.lit, fitted.params["labels"]))
    return _replace(df, {column: F.try_element_at(labels, (col(column) + 1).cast("int"))})


# --- missing values


@_stage
def _fill(df: DataFrame, values: dict) -> DataFrame:
    return _replace(df, {c: F.coalesce(col(c), F.lit(v)) for c, v in _have(df, values).items() if v is not None})


def fit_impute(df: DataFrame, columns: list[str] | None = None, strategy: str = "mean", accuracy: int | None = None) -> Fitted:
    """Numeric columns by mean, median or mode; a learned value for every column."""
    columns = columns if columns is not None else numeric(df)
    how = {
        "mean": lambda c: F.avg(c.cast("double")),
        "median": lambda c: profile.quantile(c.cast("double"), 0.5, accuracy),
        "mode": lambda c: F.mode(c, True),
    }[strategy]
    values = _row(df, {c: how(col(c)) for c in columns})
    return Fitted("fill", {"values": {c: float(v) if v is not None else None for c, v in values.items()}})


def fit_impute_categorical(df: DataFrame, columns: list[str] | None = None) -> Fitted:
    """Most frequent value, the smallest of ties; one shuffle for all columns."""
    columns = columns if columns is not None else categorical(df)
    top = {r["column"]: r["value"] for r in profile.top_values(df, columns, 1).collect()} if columns else {}
    return Fitted("fill", {"values": top})


def fill_constant(columns: list[str], value: str = "missing") -> Fitted:
    return Fitted("fill", {"values": dict.fromkeys(columns, value)})


def forward_fill(df: DataFrame, column: str, partition: list[str], order: list[str], backward: bool = False) -> DataFrame:
    from pyspark.sql import Window

    keys = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    w = Window.partitionBy(*partition).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return _replace(df, {column: F.last(col(column), ignorenulls=True).over(w)})


# --- outliers


@_stage
def _clamp(df: DataFrame, limits: dict) -> DataFrame:
    return _replace(df, {c: clamp(col(c), *x) for c, x in _have(df, limits).items() if x})


def fit_winsorize(df: DataFrame, columns: list[str], method: str = "iqr", fold: float = 1.5, task: str = "", accuracy: int | None = None) -> Fitted:
    limits = profile.bounds(df, columns, max(fold, 2.0) if task == "clustering" else fold, method, accuracy)
    return Fitted("clamp", {"limits": {c: list(x) if x else None for c, x in limits.items()}})


def fit_winsorize_target(df: DataFrame, target: str, fold: float = 3.0, accuracy: int | None = None) -> Fitted:
    """Limits of a target, where any of its values lies outside; else nothing to do."""
    lo, hi = profile.bounds(df, [target], fold, accuracy=accuracy)[target] or (None, None)
    outside = lo is not None and df.where((col(target) < lo) | (col(target) > hi)).limit(1).count() > 0
    return Fitted("clamp", {"limits": {target: [lo, hi] if outside else None}})


@_stage
def _remove_outliers(df: DataFrame, limits: dict) -> DataFrame:
    for c, x in _have(df, limits).items():
        if x:
            df = df.where(col(c).isNull() | col(c).between(*x))
    return df


# --- encoding


@_stage
def _onehot(df: DataFrame, categories: dict) -> DataFrame:
    there = _have(df, categories)
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit("missing"))
    made = [F.when(text(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for c, values in there.items() for v in values]
    return df.select(*(col(c) for c in df.columns if c not in there), *made)


def fit_onehot(df: DataFrame, columns: list[str], drop_last: bool = False) -> Fitted:
    text = df.select(*(F.coalesce(col(c).cast("string"), F.lit("missing")).alias(c) for c in columns))
    seen: dict[str, list[str]] = {c: [] for c in columns}
    most = ONEHOT_UP_TO * len(columns)
    found = profile.value_counts(text, columns).select("column", "value").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {ONEHOT_UP_TO} categories a column; encode their frequencies")
    for column, value in sorted(tuple(r) for r in found):
        seen[column].append(value)
    return Fitted("onehot", {"categories": {c: v[:-1] if drop_last and len(v) > 1 else v for c, v in seen.items()}})


@_stage
def _map_values(df: DataFrame, values: dict, tables: dict | None = None) -> DataFrame:
    made, names = {}, df.columns
    for c, m in _have(df, values).items():
        pairs = [x for k, v in m.items() for x in (F.lit(k), F.lit(v))]
        made[c] = F.try_element_at(F.create_map(*pairs), col(c).cast("string")) if pairs else F.lit(None).cast("double")
    for i, (c, path) in enumerate(_have(df, tables or {}).items()):
        known = df.sparkSession.read.schema("value string, number double").parquet(path)
        df = df.join(known.select(F.col("value").alias(f"_value{i}"), F.col("number").alias(f"_number{i}")), col(c).cast("string") == F.col(f"_value{i}"), "left")
        made[c] = F.col(f"_number{i}")
    return df.select(*((made[c] if c in made else col(c)).alias(c) for c in names))


def _value_maps(tables: dict[str, DataFrame]) -> Fitted:
    """A number for each category of a column, from ``value, number``: in the plan up to ``MAP_UP_TO`` categories, more in
    a table of the shared folder that later batches are joined with."""
    values, paths = {}, {}
    for c, t in tables.items():
        t = t.select(F.col("value").cast("string").alias("value"), F.col("number").cast("double").alias("number"))
        rows = t.limit(MAP_UP_TO + 1).collect()
        if len(rows) <= MAP_UP_TO:
            values[c] = {r["value"]: r["number"] for r in rows}
            continue
        base = t.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError(f"{c!r} has more than {MAP_UP_TO} categories; set spark.checkpoint.dir to a shared folder for their table")
        paths[c] = f"{base.rstrip('/')}/categories-{uuid.uuid4().hex}"
        t.write.parquet(paths[c])
    return Fitted("map_values", {"values": values} | ({"tables": paths} if paths else {}))


def fit_frequency(df: DataFrame, columns: list[str]) -> Fitted:
    """Share of all rows of each category; null stays null."""
    n = df.count()
    return _value_maps({c: profile.value_counts(df, [c]).select("value", (F.col("n") / n).alias("number")) for c in columns})


def fit_target_encoding(df: DataFrame, columns: list[str], target: str, smoothing: float = 10.0) -> Fitted:
    """Mean of the target per category, drawn to the overall mean by ``smoothing`` rows."""
    mean = df.agg(F.avg(col(target).cast("double"))).head()[0] or 0.0
    there, y = df.where(col(target).isNotNull()), col(target).cast("double")
    drawn = (F.sum(y) + smoothing * mean) / (F.count("*") + smoothing)
    return _value_maps({c: there.groupBy(col(c).cast("string").alias("value")).agg(drawn.alias("number")).where("value IS NOT NULL") for c in columns})


# --- transformation and scaling


@_stage
def _log(df: DataFrame, shifts: dict) -> DataFrame:
    return _replace(df, {c: shifted_log(col(c), s) for c, s in _have(df, shifts).items()})


def fit_log(df: DataFrame, columns: list[str]) -> Fitted:
    """Shift 1 - min where any value isn't positive, kept for later batches."""
    least = _row(df, {c: F.min(col(c).cast("double")) for c in columns})
    return Fitted("log", {"shifts": {c: 1 - m if m is not None and m <= 0 else 0.0 for c, m in least.items()}})


@_stage
def _yeo_johnson(df: DataFrame, powers: dict) -> DataFrame:
    return _replace(df, {c: yeo_johnson(col(c), p) for c, p in _have(df, powers).items()})


def log_likelihood(c: Column, power: float) -> Column:
    """Aggregate: Yeo-Johnson log-likelihood of a power."""
    x = c.cast("double")
    return -F.count(x) / 2 * F.log(F.var_pop(yeo_johnson(c, power))) + (power - 1) * F.sum(F.signum(x) * F.log1p(F.abs(x)))


def fit_yeo_johnson(df: DataFrame, columns: list[str], low: float = -2.0, high: float = 4.0, rounds: int = 4) -> Fitted:
    """Maximum likelihood by nested grids: every round evaluates all columns and powers in one aggregation."""
    spans = dict.fromkeys(columns, (low, high))
    for _ in range(rounds):
        grid = {(c, i): a + (b - a) * i / 12 for c, (a, b) in spans.items() for i in range(13)}
        got = _row(df, {k: log_likelihood(col(k[0]), p) for k, p in grid.items()})
        for c, (a, b) in spans.items():
            best = max(range(13), key=lambda i: got[c, i] if got[c, i] is not None and not math.isnan(got[c, i]) else -math.inf)
            step = (b - a) / 12
            spans[c] = grid[c, best] - step, grid[c, best] + step
    return Fitted("yeo_johnson", {"powers": {c: (a + b) / 2 for c, (a, b) in spans.items()}})


@_stage
def _sqrt(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: F.when(col(c) >= 0, F.sqrt(col(c))) for c in columns if c in df.columns})


@_stage
def _binarize(df: DataFrame, thresholds: dict) -> DataFrame:
    return _replace(df, {c: (col(c) > t).cast("int") for c, t in _have(df, thresholds).items()})


@_stage
def _scale(df: DataFrame, centers: dict) -> DataFrame:
    return _replace(df, {c: (col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in _have(df, centers).items()})


def fit_scale(df: DataFrame, columns: list[str] | None = None, method: str = "standard", accuracy: int | None = None) -> Fitted:
    """Standard (population deviation), minmax or robust (median, quartile range); a spread of 0 divides by 1.

    Without columns all numeric ones; an unknown method is standard.
    """
    columns = [c for c in columns if c in df.columns] if columns else numeric(df)
    x = lambda c: col(c).cast("double")
    if method == "minmax":
        got = _row(df, {c: F.array(F.min(x(c)), F.max(x(c)) - F.min(x(c))) for c in columns})
    elif method == "robust":
        got = {c: [q[1], q[2] - q[0]] if q else q for c, q in _row(df, {c: profile.quantile(x(c), [0.25, 0.5, 0.75], accuracy) for c in columns}).items()}
    else:
        got = _row(df, {c: F.array(F.avg(x(c)), F.stddev_pop(x(c))) for c in columns})
    return Fitted("scale", {"centers": {c: [v[0], v[1] or 1.0] for c, v in got.items() if v and v[0] is not None}})


# --- feature selection


def constant_shares(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, share`` of the most frequent value (null counts as a value) among all rows."""
    columns = columns or df.columns
    text = df.select(*(F.coalesce(F.concat(F.lit("v"), col(c).cast("string")), F.lit("null")).alias(c) for c in columns))
    top = profile.value_counts(text, columns).groupBy("column").agg(F.max("n").alias("n"), F.sum("n").alias("rows"))
    return top.select("column", (F.col("n") / F.col("rows")).alias("share"))


def fit_drop_constant(df: DataFrame, columns: list[str] | None = None, tol: float = 0.99) -> Fitted:
    columns = columns or df.columns
    gone = [r["column"] for r in constant_shares(df, columns).where(F.col("share") >= tol).collect()] if len(columns) >= 2 else []
    return Fitted("drop_columns", {"columns": sorted(gone)})


def duplicate_pairs(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str]]:
    """(kept, duplicate) columns of one type with equal values in every row; hashes choose what is compared."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    marks = _row(df, {c: F.concat_ws(",", F.count(col(c)), F.sum(F.xxhash64(col(c)).cast("decimal(20,0)")), F.min(F.xxhash64(col(c)))) for c in columns})
    maybe = [(a, b) for a, b in combinations(columns, 2) if types[a] == types[b] and marks[a] == marks[b]]
    same = _row(df, {p: F.bool_and(col(p[0]).eqNullSafe(col(p[1]))) for p in maybe})
    found: dict[str, str] = {}
    for a, b in maybe:
        if same[a, b] and b not in found:
            found[b] = found.get(a, a)
    return [(a, b) for b, a in found.items()]


def fit_drop_duplicates(df: DataFrame, columns: list[str] | None = None) -> Fitted:
    return Fitted("drop_columns", {"columns": sorted(b for _, b in duplicate_pairs(df, columns))})


def fit_drop_correlated(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.95) -> Fitted:
    """Greedy: of each pair above the threshold the later column goes, unless the earlier one is gone already."""
    gone: list[str] = []
    place = {c: i for i, c in enumerate(columns or numeric(df))}
    for r in sorted(profile.correlations(df, columns, threshold).collect(), key=lambda r: (place[r["a"]], place[r["b"]])):
        if r["a"] not in gone and r["b"] not in gone:
            gone.append(r["b"])
    return Fitted("drop_columns", {"columns": gone})


# --- association


@_stage
def _bins(df: DataFrame, edges: dict) -> DataFrame:
    made = {}
    for c, e in _have(df, edges).items():
        x, label = col(c).cast("double"), F.lit(None).cast("string")
        for i in range(len(e) - 2, -1, -1):
            label = F.when(x <= F.lit(e[i + 1]), F.lit(f"{c}_bin_{i}")).otherwise(label)
        made[c] = F.when(x >= F.lit(e[0]), label) if e else label
    return _replace(df, made)


def fit_bins(df: DataFrame, columns: list[str], n: int = 5, accuracy: int | None = None) -> Fitted:
    """Quantile bins (lo, hi], the lowest included; bins whose edges collapse are numbered anew."""
    got = _row(df, {c: profile.quantile(col(c).cast("double"), [i / n for i in range(n + 1)], accuracy) for c in columns})
    edges = {}
    for c, q in got.items():
        e = [a for a, b in pairwise(q) if a < b] + [q[-1]] if q else []
        edges[c] = [e[0], e[0]] if len(e) == 1 else e
    return Fitted("bins", {"edges": edges})


@_stage
def _keep_values(df: DataFrame, keep: dict, other: str = "other") -> DataFrame:
    return _replace(df, {c: F.when(col(c).isNull() | col(c).isin(v), col(c)).otherwise(F.lit(other)) for c, v in _have(df, keep).items()})


def fit_rare(df: DataFrame, columns: list[str], min_support: float = 0.01) -> Fitted:
    """Values with a smaller share of the non-null rows become ``other``, in later batches too."""
    counts = profile.value_counts(df, columns)
    total = counts.groupBy("column").agg(F.sum("n").alias("rows"))
    keep: dict[str, list[str]] = {c: [] for c in columns}
    for r in counts.join(total, "column").where(F.col("n") / F.col("rows") >= min_support).orderBy("column", "value").collect():
        keep[r["column"]].append(r["value"])
    return Fitted("keep_values", {"keep": keep})


@_stage
def _derive(df: DataFrame, snippets: list[str]) -> DataFrame:
    return derive(df, snippets)[0]


@_stage
def _stringify(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: col(c).cast("string") for c in columns if c in df.columns})


def transactions_by_key(df: DataFrame, key: str, item: str) -> DataFrame:
    """``key, items``: the distinct items of each key."""
    return df.where(col(item).isNotNull()).groupBy(col(key).alias("key")).agg(F.sort_array(F.collect_set(col(item).cast("string"))).alias("items"))


def passthrough(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.NumericType, T.StringType))]
