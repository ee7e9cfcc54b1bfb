"""Tuning, leaderboard, rubric, budget, persistence and the end-to-end run."""

from __future__ import annotations

import json
import math
import random
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import models, split
from plumbline.plans.plan import Plan, Preparer, RuleAdvisor, task_of
from plumbline.sources.tables import saved_bytes

#: Search spaces as (kind, low or choices, high, step).
_TREE = {"max_depth": ("int", 3, 30, 1), "min_samples_leaf": ("int", 1, 10, 1)}
_FOREST = _TREE | {"n_estimators": ("int", 10, 50, 10), "max_samples": ("float", 0.5, 1.0)}
_KNN = {"n_neighbors": ("int", 1, 50, 1), "weights": ("choice", ["uniform", "distance"]), "metric": ("choice", ["euclidean", "manhattan", "cosine"])}
_BAG = {"n_estimators": ("int", 10, 100, 10), "max_samples": ("float", 0.5, 1.0), "max_features": ("float", 0.5, 1.0), "bootstrap": ("choice", [True, False])}
_SVM = {"kernel": ("choice", ["linear", "rbf", "poly", "sigmoid"]), "C": ("log", 0.1, 100), "gamma": ("choice", ["scale", "auto", 0.001, 0.01, 0.1, 1.0]), "degree": ("int", 2, 5, 1), "coef0": ("float", 0.0, 1.0), "epochs": ("int", 100, 500, 50)}
SPACES: dict[str, dict] = {
    "LinearRegression": {"fit_intercept": ("choice", [True, False])},
    "Ridge": {"alpha": ("log", 0.001, 100), "epochs": ("int", 50, 500, 50)},
    "Lasso": {"alpha": ("log", 0.001, 100), "epochs": ("int", 50, 500, 50)},
    "LogisticRegression": {"epochs": ("int", 50, 500, 50), "reg": ("log", 1e-4, 0.1)},
    "SVMRegressor": _SVM | {"epsilon": ("log", 0.01, 1)},
    "SVMClassifier": _SVM,
    "DecisionTreeRegressor": _TREE,
    "DecisionTreeClassifier": _TREE | {"criterion": ("choice", ["gini", "entropy"])},
    "RandomForestRegressor": _FOREST,
    "RandomForestClassifier": _FOREST | {"criterion": ("choice", ["gini", "entropy"])},
    "BaggingClassifier": _BAG,
    "BaggingRegressor": _BAG,
    "KMeans": {"n_clusters": ("int", 2, 20, 1), "max_iter": ("int", 100, 1000, 100), "tol": ("log", 1e-6, 1e-2), "n_init": ("int", 5, 20, 1), "init": ("choice", ["k-means++", "random"])},
    "DBSCAN": {"eps": ("float", 0.1, 5.0), "min_samples": ("int", 2, 20, 1), "metric": ("choice", ["euclidean", "manhattan", "cosine"])},
    "BisectingKMeans": {"n_clusters": ("int", 2, 20, 1)},
    "KNNClassifier": _KNN,
    "KNNRegressor": _KNN,
    "Apriori": {"min_support": ("float", 0.01, 0.5), "min_confidence": ("float", 0.1, 0.9), "min_lift": ("float", 1.0, 5.0), "max_length": ("choice", [None, 2, 3, 4, 5, 6, 7, 8, 9, 10])},
}


class Sampler:
    """Seeded suggestions: at random first, then by the ratio of densities of good and other trials (TPE)."""

    def __init__(self, space: dict, seed: int = 42, start: int = 5, tries: int = 24, good: float = 0.25):
        self.space, self.rng, self.start, self.tries, self.good = space, random.Random(seed), start, tries, good
        self.trials: list[tuple[float, dict]] = []

    def _draw(self, spec):
        kind, *a = spec
        if kind == "choice":
            return self.rng.choice(a[0])
        if kind == "int":
            return self.rng.randrange(a[0], a[1] + 1, a[2])
        return math.exp(self.rng.uniform(math.log(a[0]), math.log(a[1]))) if kind == "log" else self.rng.uniform(a[0], a[1])

    @staticmethod
    def _density(spec, value, seen: list) -> float:
        kind, *a = spec
        if kind == "choice":
            return (1 + seen.count(value)) / (len(a[0]) + len(seen))
        scale = (lambda v: math.log(v)) if kind == "log" else float
        width = (scale(a[1]) - scale(a[0])) or 1.0
        h = width / max(2.0, len(seen) ** 0.5)
        return (1 / width + sum(math.exp(-(((scale(value) - scale(s)) / h) ** 2) / 2) / h for s in seen)) / (1 + len(seen))

    def suggest(self) -> dict:
        draw = lambda: {k: self._draw(s) for k, s in self.space.items()}
        if len(self.trials) < self.start:
            return draw()
        ranked = [p for _, p in sorted(self.trials, key=lambda t: -t[0])]
        cut = max(1, math.ceil(self.good * len(ranked)))
        best, others = ranked[:cut], ranked[cut:]

        def gain(p: dict) -> float:
            return sum(math.log(self._density(s, p[k], [b[k] for b in best]) / self._density(s, p[k], [o[k] for o in others])) for k, s in self.space.items())

        return max((draw() for _ in range(self.tries)), key=gain)

    def tell(self, params: dict, score: float) -> None:
        self.trials.append((score, params))


@dataclass
class Result:
    model: str
    score: float
    train_score: float
    cv_mean: float
    cv_std: float
    seconds: float
    params: dict = field(default_factory=dict)
    trials: int = 0
    error: str | None = None


def time_budget(rows: int, columns: int, mode: str = "medium") -> tuple[int, int]:
    """(seconds, trials per model) by cells and mode; an unknown mode is medium."""
    cells = rows * columns
    base = 30 if cells < 10_000 else 60 if cells < 500_000 else 120 if cells < 20_000_000 else 300
    times, trials = {"basic": (1, 3), "medium": (2, 6), "full": (4, 10)}.get(mode, (2, 6))
    return base * times, trials


def rubric(board: DataFrame) -> DataFrame:
    """``board`` with ``overfit``, ``rejected`` and ``rubric``: score .40, CV stability .25, overfit .20, time .10, simplicity .05."""
    gap = F.greatest(F.col("score") - F.col("cv_mean"), F.lit(0.0))
    w = Window.partitionBy()
    slow, many = F.max("seconds").over(w), F.max("n_params").over(w)
    value = 0.40 * F.col("score") + 0.25 * (1 - F.least(F.col("cv_std") / 0.10, F.lit(1.0))) + 0.20 * (1 - F.least(gap / 0.05, F.lit(1.0)))
    value = value + 0.10 * (1 - F.coalesce(F.try_divide("seconds", slow), F.lit(0.0))) + 0.05 * (1 - F.coalesce(F.try_divide("n_params", many), F.lit(0.0)))
    return board.withColumns({"overfit": gap > 0.05, "rejected": F.col("cv_std") > 0.10, "rubric": value})


def ranked(board: DataFrame) -> DataFrame:
    """``board`` with ``rank``: by falling score, then by model. A row for each model, so one task orders them."""
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "model")))


class AutoML:
    """Tunes the models of a task by mean cross-validated score, refits, scores on held-out rows and ranks them."""

    def __init__(self, task: str, train: DataFrame, test: DataFrame, time_budget: float = 300.0, n_trials: int = 50, cv_folds: int = 5, random_state: int = 42, only: list[str] | None = None, suggest: Callable[[str, dict], dict] | None = None):
        """``suggest(model, {"rows", "columns", "task"})`` may propose parameters, which are tried first."""
        if task not in ("classification", "regression", "clustering"):
            raise ValueError(f"no models for {task!r}")
        self.task, self.time_budget, self.n_trials, self.cv_folds, self.random_state = task, time_budget, n_trials, cv_folds, random_state
        self.train, self.test = train.persist(), test.persist()
        self.candidates = {n: c for n, c in models.registry(task).items() if not only or n in only}
        self.suggest = suggest
        self.results: list[Result] = []
        self.models: dict[str, models.Model] = {}

    @classmethod
    def with_budget(cls, task: str, train: DataFrame, test: DataFrame, mode: str = "medium", **more) -> AutoML:
        """Seconds and trials from the size of the training rows."""
        columns = len(train.columns) if "features" not in train.columns else train.select(F.max(F.size(vector_to_array("features")))).head()[0] or 1
        seconds, trials = time_budget(train.count(), columns, mode)
        return cls(task, train, test, seconds, trials, **more)

    def _proposed(self, name: str) -> dict:
        if self.suggest is None:
            return {}
        facts = {"task": self.task, "rows": self.train.count(), "columns": len(self.train.columns)}
        return {k: v for k, v in (self.suggest(name, facts) or {}).items() if k in self.candidates[name].names()}

    def _folded(self) -> DataFrame:
        keyed = self.train.withColumn("_k", F.xxhash64(*[c for c in self.train.columns]))
        return split.folds(keyed, self.cv_folds, "_k", "label" if self.task == "classification" else None, self.random_state).drop("_k").persist()

    def _cross(self, make, folded: DataFrame) -> tuple[float, float]:
        if self.task == "clustering":
            s = make().fit(self.train).score(self.test)
            return s, 0.0
        scores = [make().fit(folded.where(F.col("fold") != i).drop("fold")).score(folded.where(F.col("fold") == i).drop("fold")) for i in range(self.cv_folds)]
        mean = sum(scores) / len(scores)
        return mean, (sum((s - mean) ** 2 for s in scores) / len(scores)) ** 0.5

    def fit(self) -> AutoML:
        began, folded = time.monotonic(), self._folded()
        share = self.time_budget / max(1, len(self.candidates))
        for name, cls in self.candidates.items():
            if time.monotonic() - began > self.time_budget:
                break
            start, sampler, best, error = time.monotonic(), Sampler(SPACES.get(name, {}), self.random_state), None, None
            proposed = self._proposed(name)
            for trial in range(self.n_trials if SPACES.get(name) else 1):
                params = sampler.suggest()
                params = params | proposed if trial == 0 else params
                try:
                    mean, std = self._cross(lambda c=cls, p=params: c(**p), folded)
                except Exception as e:  # a failed trial is recorded and ranks last
                    error, mean, std = str(e)[:300], -math.inf, 0.0
                sampler.tell(params, mean)
                if best is None or mean > best[0]:
                    best = mean, std, params
                if time.monotonic() - start > share:
                    break
            if best[0] == -math.inf:
                self.results.append(Result(name, -math.inf, -math.inf, -math.inf, 0.0, time.monotonic() - start, {}, len(sampler.trials), error))
                continue
            model = cls(**best[2]).fit(self.train)
            self.models[name] = model
            self.results.append(Result(name, model.score(self.test), model.score(self.train), best[0], best[1], time.monotonic() - start, best[2], len(sampler.trials), error))
        self.results.sort(key=lambda r: (-r.score, r.cv_std, r.model))
        folded.unpersist()
        return self

    @property
    def best(self) -> str:
        return next(r.model for r in self.results if r.model in self.models)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.models[self.best].predict(df)

    def evaluate(self, overfit_gap: float = 0.1) -> dict:
        r = self.results[0]
        return {"best_model": r.model, "score": r.score, "overfitting": abs(r.train_score - r.score) > overfit_gap, "top": [asdict(x) for x in self.results[:3]], "recommendations": self._advice(r)}

    @staticmethod
    def _advice(r: Result) -> list[str]:
        out = ["regularise or simplify: the training score is well above the held-out one"] if r.train_score - r.score > 0.1 else []
        return out + (["collect more rows: folds disagree"] if r.cv_std > 0.1 else [])

    def leaderboard(self, top_k: int | None = None) -> DataFrame:
        rows = [(r.model, float(r.score), float(r.cv_mean), float(r.cv_std), float(r.seconds), len(r.params)) for r in self.results]
        board = ranked(self.train.sparkSession.createDataFrame(rows, "model string, score double, cv_mean double, cv_std double, seconds double, n_params int"))
        board = board.where(F.col("rank") <= top_k) if top_k is not None else board
        return board.select("rank", "model", "score", "cv_mean", "cv_std", "seconds", "n_params")

    def formatted(self) -> DataFrame:
        """The leaderboard with the range of the cross-validated score, one deviation to either side, and an overfit flag."""
        low, high = F.col("cv_mean") - F.col("cv_std"), F.col("cv_mean") + F.col("cv_std")
        return self.leaderboard().withColumns({"cv_low": low, "cv_high": high, "overfit": F.greatest(F.col("score") - F.col("cv_mean"), F.lit(0.0)) > 0.05})

    def export(self, path: str | None = None) -> str:
        """Configuration, summary, results and failed models as JSON; written as a text file below ``path``, if given."""
        failed = [{"model": r.model, "error": r.error} for r in self.results if r.model not in self.models]
        results = [asdict(r) | {"cv_low": r.cv_mean - r.cv_std, "cv_high": r.cv_mean + r.cv_std} for r in self.results]
        config = {"task": self.task, "n_trials": self.n_trials, "cv_folds": self.cv_folds, "time_budget": self.time_budget, "random_state": self.random_state}
        summary = {"best_model": self.best if self.models else None, "models": len(self.results), "failed": failed, "at": datetime.now(timezone.utc).isoformat()}
        text = json.dumps({"config": config, "summary": summary, "results": results})
        if path:
            self.train.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return text

    def _save(self, name: str, path: str) -> None:
        spark = self.train.sparkSession
        self.models[name].save(f"{path}/{name}", spark)
        r = next(x for x in self.results if x.model == name)
        facts = asdict(r) | {"task": self.task, "at": datetime.now(timezone.utc).isoformat(), "megabytes": saved_bytes(spark, f"{path}/{name}") / 1e6}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/metadata")

    def save_best(self, path: str) -> None:
        self._save(self.best, path)

    def save_all(self, path: str) -> None:
        for n in self.models:
            self._save(n, path)

    @staticmethod
    def load_model(path: str, spark: SparkSession) -> models.Model:
        return models.load(path, spark)


def training_pipeline(df: DataFrame, key: str, target: str | None, ml_type: str, method: str, plan: Plan | None = None, test_size: float = 0.2, n_trials: int = 30, budget: float = 300.0, seed: int = 42, only: list[str] | None = None, cv_folds: int = 3) -> dict:
    """Split, plan, prepare, train, evaluate: nothing of the held-out rows reaches a fitted number."""
    task = task_of(ml_type, method)
    if task == "classification":
        marked = split.stratified(df.where(F.col(target).isNotNull()), target, key, test_size, seed).persist()
        train, test = marked.where("NOT is_test").drop("is_test"), marked.where("is_test").drop("is_test")
    else:
        train, test = split.train_test(df, key, test_size, seed)
    train, test = train.drop(key), test.drop(key)
    plan = plan or RuleAdvisor().plan(train, task, target)
    preparer = Preparer(task, target)
    a = preparer.fit_transform(train, plan)
    b = preparer.transform(test)
    columns = [c for c, t in a.dtypes if c != target and t not in ("string", "timestamp", "date", "boolean")]
    run = AutoML(task, models.assemble(a, columns, target), models.assemble(b, columns, target), budget, n_trials, cv_folds, seed, only).fit()
    return {"plan": plan, "preparer": preparer, "automl": run, "evaluation": run.evaluate()}
