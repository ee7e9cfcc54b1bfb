"""The preprocessing plan: data with a JSON form, validation, a rule-based advisor and its execution."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.columns import categorical, col, numeric
from plumbline.operators import prep, profile

TASKS = {"supervised": ("classification", "regression"), "unsupervised": ("clustering", "association")}


def task_of(ml_type: str, method: str) -> str:
    """The task for a pair of names in any case; other pairs raise."""
    kind, name = ml_type.strip().lower(), method.strip().lower()
    if name not in TASKS.get(kind, ()):
        raise ValueError(f"{method!r} isn't a method of {ml_type!r}; there are {TASKS}")
    return name


@dataclass
class Plan:
    drop: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    derived: list[str] = field(default_factory=list)
    numeric_strategy: str | None = None
    outlier_columns: list[str] = field(default_factory=list)
    capping_method: str = "iqr"
    fold: float = 1.5
    onehot: list[str] = field(default_factory=list)
    frequency: list[str] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    yeo_johnson: list[str] = field(default_factory=list)
    scaling: str | None = None
    scaling_columns: list[str] = field(default_factory=list)
    drop_constant: bool = False
    drop_correlated: bool = False
    correlation_threshold: float = 0.95
    binning: list[str] = field(default_factory=list)
    n_bins: int = 5
    min_support: float = 0.01
    summary: dict = field(default_factory=dict)

    def without(self, target: str | None) -> Plan:
        """The target taken out of the lists of columns to drop and keep."""
        out = Plan(**asdict(self))
        out.drop, out.keep = [c for c in self.drop if c != target], [c for c in self.keep if c != target]
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Plan:
        return Plan(**json.loads(text))

    @staticmethod
    def from_contract(d: dict) -> Plan:
        """From the nested form with columns_to_drop, columns_to_keep and pipeline_recommendation, which must be there."""
        for k in ("columns_to_drop", "columns_to_keep", "pipeline_recommendation"):
            if k not in d:
                raise ValueError(f"the plan lacks {k}")
        p = d["pipeline_recommendation"] or {}
        step = lambda k: p.get(k) or {}
        outliers, parameters = step("step_2_outliers"), step("step_2_outliers").get("parameters") or {}
        names = lambda x: list(x) if isinstance(x, list) else []
        keep = [c["column_name"] if isinstance(c, dict) else c for c in names(d["columns_to_keep"])]
        return Plan(
            drop=names((d["columns_to_drop"] or {}).get("column_list")),
            keep=keep,
            derived=[s for f in d.get("feature_engineering_suggestions") or [] for s in names(f.get("transformation"))],
            numeric_strategy=step("step_1_missing_values").get("numeric_strategy"),
            outlier_columns=names(outliers.get("columns_affected")) if outliers.get("method") == "winsorization" else [],
            capping_method=parameters.get("capping_method", "iqr"),
            fold=parameters.get("fold", 1.5),
            onehot=names(step("step_3_encoding").get("onehot_columns")),
            frequency=names(step("step_3_encoding").get("frequency_columns")),
            log=names(step("step_4_transformation").get("log_transform")),
            yeo_johnson=names(step("step_4_transformation").get("yeo_johnson")),
            scaling=step("step_5_scaling").get("method"),
            scaling_columns=names(step("step_5_scaling").get("columns")),
            drop_constant=bool(step("step_6_feature_selection").get("drop_constant")),
            drop_correlated=bool(step("step_6_feature_selection").get("drop_correlated")),
            correlation_threshold=step("step_6_feature_selection").get("correlation_threshold", 0.95),
            binning=names(step("step_7_association").get("binning_columns")),
            n_bins=step("step_7_association").get("n_bins", 5),
            min_support=step("step_7_association").get("min_support", 0.01),
            summary=d.get("summary") or {},
        )


class Advisor(Protocol):
    def plan(self, df: DataFrame, task: str, target: str | None) -> Plan: ...


class RuleAdvisor:
    """Fixed rules over the profile: ids and mostly missing columns go, outliers are capped, few categories one-hot."""

    def __init__(self, onehot_up_to: int = 20, missing_above: float = 60.0, skew: float = 1.0):
        self.onehot_up_to, self.missing_above, self.skew = onehot_up_to, missing_above, skew

    def plan(self, df: DataFrame, task: str, target: str | None = None) -> Plan:
        x = df.select(*(col(c) for c in df.columns if c != target))
        rows = x.count()
        gone = {r["column"] for r in profile.missing(x).where(F.col("percent") > self.missing_above).collect()}
        distinct = {r["column"]: r["distinct"] for r in profile.categorical_profile(x, x.columns).collect()}
        integral = {n for n, t in x.dtypes if t in ("tinyint", "smallint", "int", "bigint", "string")}
        gone |= {c for c, d in distinct.items() if rows and d == rows and c in integral}
        numbers = [c for c in numeric(x) if c not in gone]
        texts = [c for c in categorical(x) if c not in gone]
        skews = x.agg(*(F.struct(F.skewness(col(c).cast("double")).alias("s"), F.min(col(c).cast("double")).alias("m")).alias(f"x{i}") for i, c in enumerate(numbers))).head() if numbers else []
        skewed = {c: r["m"] for c, r in zip(numbers, skews, strict=True) if r["s"] is not None and abs(r["s"]) > self.skew}
        capped = [r["column"] for r in profile.outliers(x, numbers).where("outliers > 0").collect()] if numbers else []
        return Plan(
            drop=sorted(gone),
            keep=[c for c in x.columns if c not in gone],
            numeric_strategy="median" if task == "clustering" else "mean",
            outlier_columns=capped,
            onehot=[c for c in texts if distinct.get(c, 0) <= self.onehot_up_to],
            frequency=[c for c in texts if distinct.get(c, 0) > self.onehot_up_to],
            log=[c for c, m in skewed.items() if m > 0],
            yeo_johnson=[c for c, m in skewed.items() if m <= 0],
            scaling="standard",
            scaling_columns=numbers,
            drop_constant=True,
            drop_correlated=True,
        )


class Preparer:
    """Fits a plan on training rows and replays it. Rows carry their target; nothing is aligned by position."""

    def __init__(self, task: str, target: str | None = None):
        self.task, self.target = task, target
        self.stages: list[prep.Fitted] = []
        self.target_stages: list[prep.Fitted] = []
        self.log: list[dict] = []

    def _features(self, df: DataFrame, columns: list[str]) -> list[str]:
        return [c for c in columns if c in df.columns and c != self.target]

    def fit_transform(self, df: DataFrame, plan: Plan) -> DataFrame:
        plan = plan.without(self.target)
        self.stages, self.target_stages, self.log = [], [], []

        def run(stage: prep.Fitted, of_target: bool = False) -> None:
            nonlocal df
            before = df.columns
            df = stage.transform(df)
            (self.target_stages if of_target else self.stages).append(stage)
            self.log.append({"stage": stage.kind, "added": [c for c in df.columns if c not in before], "removed": [c for c in before if c not in df.columns], "params": stage.params})

        t, cluster = self.target, self.task == "clustering"
        if t:
            run(prep.Fitted("drop_null_rows", {"columns": [t]}), True)
            if self.task == "classification" and dict(df.dtypes)[t] == "string":
                run(prep.fit_label_encode(df, t), True)
            if self.task == "regression":
                run(prep.Fitted("numeric_target", {"target": t}), True)
                run(prep.fit_winsorize_target(df, t), True)
        if plan.drop:
            run(prep.Fitted("drop_columns", {"columns": self._features(df, plan.drop)}))
        if self.task == "association":
            texts, numbers = categorical(df), numeric(df)
            run(prep.fill_constant(texts))
            run(prep.Fitted("drop_null_rows", {"columns": numbers}) if plan.numeric_strategy == "drop_rows" else prep.fit_impute(df, numbers, "median"))
            if bins := [c for c in plan.binning if c in numbers]:
                run(prep.fit_bins(df, bins, plan.n_bins))
            run(prep.Fitted("stringify", {"columns": numbers}))
            run(prep.fit_rare(df, texts, plan.min_support))
            return df
        numbers, texts = self._features(df, numeric(df)), self._features(df, categorical(df))
        run(prep.fit_impute(df, numbers, plan.numeric_strategy if plan.numeric_strategy in ("mean", "median", "mode") else "median" if cluster else "mean"))
        run(prep.fit_impute_categorical(df, texts))
        if columns := self._features(df, plan.outlier_columns):
            run(prep.fit_winsorize(df, [c for c in columns if c in numbers], plan.capping_method, plan.fold, self.task))
        if plan.derived:
            run(prep.Fitted("derive", {"snippets": plan.derived}))
        if columns := self._features(df, plan.onehot):
            run(prep.fit_onehot(df, columns, drop_last=cluster))
        if columns := self._features(df, plan.frequency):
            run(prep.fit_frequency(df, columns))
        numbers = self._features(df, numeric(df))
        if columns := [c for c in plan.log if c in numbers]:
            run(prep.fit_log(df, columns))
        if columns := [c for c in plan.yeo_johnson if c in numbers]:
            run(prep.fit_yeo_johnson(df, columns))
        if plan.scaling:
            columns = [c for c in plan.scaling_columns if c in numbers] or (numbers if cluster else [])
            if columns:
                run(prep.fit_scale(df, columns, plan.scaling))
        if plan.drop_constant:
            run(prep.fit_drop_constant(df, self._features(df, df.columns), 0.98 if cluster else 0.99))
            run(prep.fit_drop_duplicates(df, self._features(df, df.columns)))
        if plan.drop_correlated:
            run(prep.fit_drop_correlated(df, self._features(df, numeric(df)), plan.correlation_threshold))
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        """Replays the fitted stages; target stages only where the target is there. Errors propagate."""
        if not self.stages:
            raise RuntimeError("fit_transform first")
        if self.target in df.columns:
            for s in self.target_stages:
                df = s.transform(df)
        for s in self.stages:
            df = s.transform(df)
        return df

    def inverse_target(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        for s in self.target_stages:
            if s.kind == "label_encode":
                df = prep.inverse_label(df, s, column)
        return df

    def to_json(self) -> str:
        return json.dumps({"task": self.task, "target": self.target, "stages": [s.to_json() for s in self.stages], "target_stages": [s.to_json() for s in self.target_stages], "log": self.log})

    @staticmethod
    def from_json(text: str) -> Preparer:
        d = json.loads(text)
        out = Preparer(d["task"], d["target"])
        out.stages, out.target_stages = ([prep.Fitted.from_json(s) for s in d[k]] for k in ("stages", "target_stages"))
        out.log = d["log"]
        return out


def difference(before: DataFrame, after: DataFrame) -> dict:
    """Shapes, columns added and removed, missing cells of two stages of a table."""
    cells = lambda df: sum(df.agg(*(F.count_if(col(c).isNull()).alias(f"x{i}") for i, c in enumerate(df.columns))).head())
    return {
        "shape_before": [before.count(), len(before.columns)],
        "shape_after": [after.count(), len(after.columns)],
        "added": [c for c in after.columns if c not in before.columns],
        "removed": [c for c in before.columns if c not in after.columns],
        "missing_before": cells(before),
        "missing_after": cells(after),
    }
