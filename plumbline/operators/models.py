"""Models with one interface: ``fit(df)``, ``predict(df)`` (adds ``prediction``), ``score(df)``, parameters, save, load.

Rows carry a vector column ``features`` and a ``label``. Labels of classifiers may be any values: they are indexed by
sorted order and mapped back. Most models wrap the ML library; those it lacks (voting, epsilon-insensitive
regression, absolute-error stumps, neighbours, density clusters) are aggregations of their own.
"""

from __future__ import annotations

import inspect
import json
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import classification as mlc
from pyspark.ml import clustering as mlk
from pyspark.ml import regression as mlr
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.columns import col, numeric
from plumbline.functions.scalar import dot, kernel
from plumbline.operators import metrics, neighbours
from plumbline.operators.neighbours import numbered

SEED = 42


def assemble(df: DataFrame, columns: list[str] | None = None, label: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``features`` (doubles) and ``label``; rows with a null feature raise, as a model can't use them."""
    columns = columns or [c for c in numeric(df) if c != label]
    checked = [F.coalesce(col(c).cast("double"), F.raise_error(F.lit(f"null in {c}")).cast("double")) for c in columns]
    return df.select(*(col(c) for c in keep or []), array_to_vector(F.array(*checked)).alias("features"), *([col(label).alias("label")] if label else []))


class Model:
    """Parameters are the constructor's arguments."""

    task = ""

    @classmethod
    def names(cls) -> list[str]:
        return [p for p in inspect.signature(cls.__init__).parameters if p != "self"]

    def get_params(self) -> dict:
        return {p: getattr(self, p) for p in self.names()}

    def set_params(self, **params) -> Model:
        for k, v in params.items():
            if k not in self.names():
                raise ValueError(f"unknown parameter {k!r}")
            setattr(self, k, v)
        return self

    fitted = None

    def _need(self):
        if self.fitted is None:
            raise RuntimeError("fit first")
        return self.fitted

    def fit(self, df: DataFrame) -> Model:
        raise NotImplementedError

    def predict(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def state(self) -> dict:
        """What ``save`` writes as JSON besides the parameters."""
        return {}

    def save(self, path: str, spark: SparkSession) -> None:
        self._need()
        text = json.dumps({"model": type(self).__name__, "params": self.get_params(), "state": self.state()})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        self._save_parts(path)

    def _save_parts(self, path: str) -> None:
        pass

    def _load_parts(self, path: str, spark: SparkSession, state: dict) -> None:
        self.fitted = state


def load(path: str, spark: SparkSession) -> Model:
    meta = json.loads(spark.read.text(f"{path}/model").head()[0])
    model = REGISTRY[meta["model"]](**meta["params"])
    model._load_parts(path, spark, meta["state"])
    return model


class Classifier(Model):
    task = "classification"
    labels: list | None = None

    def _indexed(self, df: DataFrame) -> DataFrame:
        self.labels = [r[0] for r in df.select("label").where("label IS NOT NULL").distinct().orderBy("label").collect()]
        codes = F.create_map(*(F.lit(x) for i, v in enumerate(self.labels) for x in (v, float(i))))
        return df.where("label IS NOT NULL").withColumn("label", F.try_element_at(codes, F.col("label")))

    def _named(self, c: Column) -> Column:
        return F.try_element_at(F.array(*map(F.lit, self.labels)), (c + 1).cast("int"))

    def score(self, df: DataFrame) -> float:
        return self.predict(df).agg(metrics.accuracy()).head()[0] or 0.0


class Regressor(Model):
    task = "regression"
    linear = False

    def score(self, df: DataFrame) -> float:
        return self.predict(df).agg(metrics.r2(perfect_if_exact=self.linear)).head()[0] or 0.0


class _Library:
    """Mixin for estimators of the ML library: ``_estimator()`` makes one, persistence is the library's."""

    reader = None

    @property
    def history_(self) -> list[float]:
        """The objective of each iteration, where the estimator has iterations and was fitted in this session."""
        fitted = self._need()
        return [float(x) for x in getattr(fitted.summary, "objectiveHistory", [])] if getattr(fitted, "hasSummary", False) else []

    def state(self) -> dict:
        return {"labels": getattr(self, "labels", None)}

    def _save_parts(self, path: str) -> None:
        self.fitted.write().overwrite().save(f"{path}/fitted")

    def _load_parts(self, path: str, spark: SparkSession, state: dict) -> None:
        self.labels = state["labels"]
        self.fitted = self.reader.load(f"{path}/fitted")


class _LibraryClassifier(_Library, Classifier):
    def fit(self, df: DataFrame) -> Model:
        self.fitted = self._estimator().fit(self._indexed(df))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self._need().transform(df.withColumnRenamed("label", "_label"))
        out = out.withColumn("prediction", self._named(F.col("prediction"))).drop("rawPrediction")
        return out.withColumnRenamed("_label", "label")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.predict(df).withColumn("probability", vector_to_array("probability"))


class _LibraryRegressor(_Library, Regressor):
    def fit(self, df: DataFrame) -> Model:
        self.fitted = self._estimator().fit(df.where("label IS NOT NULL").withColumn("label", F.col("label").cast("double")))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self._need().transform(df)


class LinearRegression(_LibraryRegressor):
    linear, reader = True, mlr.LinearRegressionModel

    def __init__(self, fit_intercept: bool = True):
        self.fit_intercept = fit_intercept

    def _estimator(self):
        return mlr.LinearRegression(fitIntercept=self.fit_intercept, regParam=0.0, solver="normal")

    @property
    def coef_(self) -> list[float]:
        return [float(x) for x in self._need().coefficients]

    @property
    def intercept_(self) -> float:
        return float(self._need().intercept)

    def residuals(self, df: DataFrame) -> DataFrame:
        return self.predict(df).withColumn("residual", F.col("label") - F.col("prediction"))


class Ridge(LinearRegression):
    """Mean squared error plus alpha times the squared norm; the intercept is free. Solved at once: ``epochs`` is for iterative solvers."""

    def __init__(self, alpha: float = 1.0, epochs: int = 100):
        self.alpha, self.epochs = alpha, epochs

    def _estimator(self):
        return mlr.LinearRegression(regParam=self.alpha * self.spread, elasticNetParam=0.0, standardization=False, solver="normal")

    def fit(self, df: DataFrame) -> Model:
        # The library divides the penalty by the label's deviation over all rows.
        self.spread = df.agg(F.stddev_pop(F.col("label").cast("double"))).head()[0] or 1.0
        return super().fit(df)


class Lasso(LinearRegression):
    """Mean squared error plus alpha times the sum of absolute weights; the library halves the error, hence alpha / 2."""

    def __init__(self, alpha: float = 1.0, epochs: int = 100):
        self.alpha, self.epochs = alpha, epochs

    def _estimator(self):
        return mlr.LinearRegression(regParam=self.alpha / 2, elasticNetParam=1.0, standardization=False, maxIter=self.epochs)


class LogisticRegression(_LibraryClassifier):
    reader = mlc.LogisticRegressionModel

    def __init__(self, epochs: int = 100, reg: float = 0.0):
        self.epochs, self.reg = epochs, reg

    def _estimator(self):
        return mlc.LogisticRegression(maxIter=self.epochs, regParam=self.reg, standardization=False)


#: The library's limit; no limit (None) means this one.
_MOST_DEPTH = 30
#: Names of the impurities that the library's trees offer, and their own names.
_IMPURITY = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy", "mse": "variance", "squared_error": "variance", "variance": "variance"}


class _Tree(_Library):
    """Trees of the library, by quantile bins. ``weight_col`` names a column of row weights."""

    impurities: tuple[str, ...] = ("gini", "entropy")

    def __init__(self, max_depth: int | None = None, min_samples_leaf: int = 1, criterion: str = "gini", max_bins: int = 32, random_state: int = SEED, min_samples_split: int = 2, weight_col: str | None = None):
        self.max_depth, self.min_samples_leaf, self.criterion, self.max_bins, self.random_state = max_depth, min_samples_leaf, criterion, max_bins, random_state
        self.min_samples_split, self.weight_col = min_samples_split, weight_col

    def _args(self) -> dict:
        if (kind := _IMPURITY.get(self.criterion)) not in self.impurities:
            raise ValueError(f"criterion {self.criterion!r} is not offered here; best_stump has 'mae'")
        if self.max_depth is not None and not 0 <= self.max_depth <= _MOST_DEPTH:
            raise ValueError(f"max_depth is None or 0 to {_MOST_DEPTH}")
        if self.min_samples_split > 2 * self.min_samples_leaf and self.min_samples_split > 2:
            raise ValueError("min_samples_split beyond twice min_samples_leaf is not offered; raise min_samples_leaf")
        args = {"maxDepth": _MOST_DEPTH if self.max_depth is None else self.max_depth, "minInstancesPerNode": self.min_samples_leaf, "maxBins": self.max_bins, "seed": self.random_state, "impurity": kind}
        return args | ({"weightCol": self.weight_col} if self.weight_col else {})

    @property
    def depth(self) -> int:
        return self._need().depth

    @property
    def leaves(self) -> int:
        return (self._need().numNodes + 1) // 2

    @property
    def feature_importances_(self) -> list[float]:
        return self._need().featureImportances.toArray().tolist()


class DecisionTreeClassifier(_Tree, _LibraryClassifier):
    reader = mlc.DecisionTreeClassificationModel

    def _estimator(self):
        return mlc.DecisionTreeClassifier(**self._args())


class DecisionTreeRegressor(_Tree, _LibraryRegressor):
    reader, impurities = mlr.DecisionTreeRegressionModel, ("variance",)

    def __init__(self, max_depth: int | None = None, min_samples_leaf: int = 1, criterion: str = "mse", max_bins: int = 32, random_state: int = SEED, min_samples_split: int = 2, weight_col: str | None = None):
        super().__init__(max_depth, min_samples_leaf, criterion, max_bins, random_state, min_samples_split, weight_col)

    def _estimator(self):
        return mlr.DecisionTreeRegressor(**self._args())


class _Forest(_Tree):
    def __init__(self, n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1, max_features: str | float = "sqrt", criterion: str = "gini", bootstrap: bool = True, max_samples: float | None = None, random_state: int = SEED, min_samples_split: int = 2, weight_col: str | None = None):
        super().__init__(max_depth, min_samples_leaf, criterion, 32, random_state, min_samples_split, weight_col)
        self.n_estimators, self.max_features, self.bootstrap, self.max_samples = n_estimators, max_features, bootstrap, max_samples

    def _args(self) -> dict:
        features = "all" if self.max_features in (1.0, None, "all") else str(self.max_features)
        return super()._args() | {"numTrees": self.n_estimators, "featureSubsetStrategy": features, "subsamplingRate": self.max_samples or 1.0, "bootstrap": self.bootstrap}

    @property
    def depth(self) -> int:
        return max(t.depth for t in self._need().trees)


class RandomForestClassifier(_Forest, _LibraryClassifier):
    reader = mlc.RandomForestClassificationModel

    def _estimator(self):
        return mlc.RandomForestClassifier(**self._args())


class RandomForestRegressor(_Forest, _LibraryRegressor):
    reader, impurities = mlr.RandomForestRegressionModel, ("variance",)

    def __init__(self, n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1, max_features: str | float = 1.0, criterion: str = "squared_error", bootstrap: bool = True, max_samples: float | None = None, random_state: int = SEED, min_samples_split: int = 2, weight_col: str | None = None):
        super().__init__(n_estimators, max_depth, min_samples_leaf, max_features, criterion, bootstrap, max_samples, random_state, min_samples_split, weight_col)

    def _estimator(self):
        return mlr.RandomForestRegressor(**self._args())


class _Bagging(Model):
    """Members on samples of rows and features, fitted by a few driver threads; seed + i for member i.

    ``base_estimator`` names another model of the ML library than the trees; ``bootstrap_features`` draws features with
    replacement.
    """

    def __init__(self, n_estimators: int = 10, max_samples: float = 1.0, max_features: float = 1.0, bootstrap: bool = True, max_depth: int | None = 5, random_state: int = SEED, base_estimator: str | None = None, bootstrap_features: bool = False):
        self.n_estimators, self.max_samples, self.max_features, self.bootstrap, self.max_depth, self.random_state = n_estimators, max_samples, max_features, bootstrap, max_depth, random_state
        self.base_estimator, self.bootstrap_features = base_estimator, bootstrap_features

    base: type[Model]

    def _member(self, seed: int) -> Model:
        if self.base_estimator is None:
            return self.base(max_depth=self.max_depth, random_state=seed)
        made = REGISTRY.get(self.base_estimator)
        if made is None or not issubclass(made, _Library) or made.task != self.task:
            raise ValueError(f"{self.base_estimator!r} is no {self.task} model of the library")
        return made()

    def fit(self, df: DataFrame) -> Model:
        import random

        rows = self._indexed(df) if isinstance(self, Classifier) else df
        size = vector_to_array("features")
        width = rows.select(F.max(F.size(size))).head()[0]
        fraction = self.max_samples if self.max_samples <= 1 else min(1.0, self.max_samples / max(1, rows.count()))
        rows = rows.persist()

        def member(i: int):
            k = max(1, round(width * self.max_features)) if self.max_features <= 1 else int(self.max_features)
            rng = random.Random(self.random_state + i)
            chosen = sorted(rng.choices(range(width), k=k) if self.bootstrap_features else rng.sample(range(width), min(k, width)))
            part = rows.sample(self.bootstrap, fraction, self.random_state + i).withColumn("features", self._part(chosen))
            return chosen, self._member(self.random_state + i).fit(part)

        with ThreadPoolExecutor(3) as pool:
            self.fitted = list(pool.map(member, range(self.n_estimators)))
        rows.unpersist()
        return self

    @staticmethod
    def _part(chosen: list[int]) -> Column:
        values = vector_to_array("features")
        return array_to_vector(F.array(*(values[i] for i in chosen)))

    def _votes(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({"_all": F.col("features"), "_votes": F.array().cast("array<double>")})
        for chosen, m in self._need():
            out = out.withColumn("features", self._part(chosen)) if len(chosen) else out
            drop = ("rawPrediction", "probability")
            # A member numbers the classes of its own sample, which need not hold them all.
            vote = m._named(F.col("prediction")) if isinstance(m, Classifier) else F.col("prediction")
            out = m.fitted.transform(out).drop(*drop).withColumn("_votes", F.array_append("_votes", vote)).drop("prediction").withColumn("features", F.col("_all"))
        return out.drop("_all")

    def state(self) -> dict:
        return {"chosen": [c for c, _ in self._need()], "labels": getattr(self, "labels", None), "member_labels": [getattr(m, "labels", None) for _, m in self._need()]}

    def _save_parts(self, path: str) -> None:
        for i, (_, m) in enumerate(self.fitted):
            m.fitted.write().overwrite().save(f"{path}/member-{i}")

    def _load_parts(self, path: str, spark: SparkSession, state: dict) -> None:
        self.labels, self.fitted = state["labels"], []
        for i, chosen in enumerate(state["chosen"]):
            m = self._member(self.random_state + i)
            m.labels = state["member_labels"][i]
            m.fitted = m.reader.load(f"{path}/member-{i}")
            self.fitted.append((chosen, m))


def vote_shares(votes: Column, n: int) -> Column:
    """The share of the votes for each of the classes 0 to n - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(votes, lambda v: v == i)) / F.size(votes))


def most_votes(shares: Column) -> Column:
    """The class of the largest share, the smallest of ties."""
    return F.array_position(shares, F.array_max(shares)) - 1


class BaggingClassifier(_Bagging, Classifier):
    """Majority vote, ties to the smallest class; the probability of a class is its share of the votes."""

    base = DecisionTreeClassifier

    def fit(self, df: DataFrame) -> Model:
        super().fit(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = self._votes(df)
        out = out.withColumn("probability", vote_shares(F.col("_votes"), len(self.labels))).drop("_votes")
        return out.withColumn("prediction", self._named(most_votes(F.col("probability"))))

    predict_proba = predict


class BaggingRegressor(_Bagging, Regressor):
    base = DecisionTreeRegressor

    def predict(self, df: DataFrame) -> DataFrame:
        out = self._votes(df)
        return out.withColumn("prediction", F.aggregate("_votes", F.lit(0.0), lambda a, x: a + x) / F.size("_votes")).drop("_votes")


def fourier(df: DataFrame, width: int, gamma: float, places: int = 64, seed: int = SEED) -> DataFrame:
    """Random Fourier features of the Gaussian kernel in place of ``features``."""
    import random

    rng = random.Random(seed)
    x = vector_to_array("features")
    waves = [F.cos(dot(x, F.array(*(F.lit(rng.gauss(0, math.sqrt(2 * gamma))) for _ in range(width)))) + rng.uniform(0, 2 * math.pi)) * math.sqrt(2 / places) for _ in range(places)]
    return df.withColumn("features", array_to_vector(F.array(*waves)))


def landmarks(df: DataFrame, most: int) -> list[list[float]]:
    """At most ``most`` different points of ``features``, the smallest by a hash: a bounded sample."""
    x = df.select(vector_to_array("features").alias("x")).distinct()
    return [list(r["x"]) for r in x.orderBy(F.xxhash64("x"), "x").limit(most).collect()]


class _Kernelled:
    """A linear machine on explicit features of the kernel.

    None for linear, random Fourier features for rbf. For poly and sigmoid, which has no such map, features are the
    kernel's values at ``LANDMARKS`` points of the training rows (the empirical kernel map).
    """

    LANDMARKS = 64
    points: list[list[float]] | None = None

    def _width(self, df: DataFrame) -> None:
        if self.kernel not in ("linear", "rbf", "poly", "sigmoid"):
            raise ValueError(f"unknown kernel {self.kernel!r}")
        x = vector_to_array("features")
        self.width = df.select(F.max(F.size(x))).head()[0] or 1
        if self.gamma == "scale":
            v = df.select(F.explode(x).alias("v")).agg(F.var_pop("v")).head()[0]
            self.gamma_ = 1 / (self.width * v) if v else 1.0
        else:
            self.gamma_ = 1 / self.width if self.gamma == "auto" else float(self.gamma)
        self.points = landmarks(df, self.LANDMARKS) if self.kernel in ("poly", "sigmoid") else None

    def _mapped(self, df: DataFrame) -> DataFrame:
        if self.kernel == "linear":
            return df
        if self.points is None:
            return fourier(df, self.width, self.gamma_)
        x = vector_to_array("features")
        values = F.transform(F.lit(self.points), lambda p: kernel(x, p, self.kernel, self.gamma_, self.degree, self.coef0))
        return df.withColumn("features", array_to_vector(values))


class SVMClassifier(_Kernelled, Classifier):
    """One-against-rest linear hinge machines; the probability is the softmax of their margins."""

    def __init__(self, C: float = 1.0, kernel: str = "rbf", gamma: str | float = "scale", degree: int = 3, epochs: int = 100, coef0: float = 0.0):
        self.C, self.kernel, self.gamma, self.degree, self.epochs, self.coef0 = C, kernel, gamma, degree, epochs, coef0

    def fit(self, df: DataFrame) -> Model:
        self._width(df)
        rows = self._mapped(self._indexed(df)).persist()
        n = max(1, rows.count())
        self.fitted = []
        for i in range(len(self.labels)):
            one = mlc.LinearSVC(maxIter=self.epochs, regParam=1 / (2 * self.C * n)).fit(rows.withColumn("label", (F.col("label") == i).cast("double")))
            self.fitted.append([[float(x) for x in one.coefficients], float(one.intercept)])
        rows.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        from plumbline.functions.scalar import softmax

        x = vector_to_array("features")
        margins = F.array(*(dot(x, F.array(*map(F.lit, w))) + b for w, b in self._need()))
        mapped = self._mapped(df.withColumn("_features", F.col("features")))
        out = mapped.withColumn("_m", margins).withColumn("features", F.col("_features")).drop("_features")
        return out.withColumns({"prediction": self._named(F.array_position("_m", F.array_max("_m")) - 1), "probability": softmax(F.col("_m"))}).drop("_m")

    predict_proba = predict

    def state(self) -> dict:
        return {"labels": self.labels, "weights": self.fitted, "width": self.width, "gamma_": self.gamma_, "points": self.points}

    def _load_parts(self, path: str, spark: SparkSession, state: dict) -> None:
        self.labels, self.fitted, self.width, self.gamma_ = state["labels"], state["weights"], state["width"], state["gamma_"]
        self.points = state.get("points")


class SVMRegressor(_Kernelled, Regressor):
    """Epsilon-insensitive loss, full-batch subgradients: one aggregation an epoch, averaged weights."""

    def __init__(self, C: float = 1.0, epsilon: float = 0.1, kernel: str = "linear", gamma: str | float = "scale", degree: int = 3, epochs: int = 30, lr: float = 0.5, coef0: float = 0.0):
        self.C, self.epsilon, self.kernel, self.gamma, self.degree, self.epochs, self.lr, self.coef0 = C, epsilon, kernel, gamma, degree, epochs, lr, coef0

    def fit(self, df: DataFrame) -> Model:
        self._width(df)
        rows = self._mapped(df.where("label IS NOT NULL")).select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).persist()
        d = rows.select(F.max(F.size("x"))).head()[0] or 1
        stats = rows.agg(F.count("*"), F.avg("y"), F.stddev_pop("y"), *(F.array(F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])) for i in range(d))).head()
        n, my, sy = stats[0] or 1, stats[1] or 0.0, stats[2] or 1.0
        mean, std = [s[0] for s in stats[3:]], [s[1] or 1.0 for s in stats[3:]]
        w, b, total, base = [0.0] * d, 0.0, [0.0] * d, 0.0
        z = [(F.col("x")[i] - mean[i]) / std[i] for i in range(d)]
        for t in range(1, self.epochs + 1):
            error = sum((z[i] * w[i] for i in range(d)), F.lit(b)) - (F.col("y") - my) / sy
            sign = F.when(error > self.epsilon, 1.0).when(error < -self.epsilon, -1.0).otherwise(0.0)
            g = rows.agg(F.sum(sign), *(F.sum(sign * z[i]) for i in range(d))).head()
            rate = self.lr / math.sqrt(t)
            w = [w[i] - rate * (g[i + 1] / n + w[i] / (self.C * n)) for i in range(d)]
            b -= rate * g[0] / n
            total, base = [a + c for a, c in zip(total, w, strict=True)], base + b
        rows.unpersist()
        half = self.epochs
        w, b = [x / half for x in total], base / half
        slopes = [sy * w[i] / std[i] for i in range(d)]
        self.fitted = {"w": slopes, "b": my + sy * b - sum(s * m for s, m in zip(slopes, mean, strict=True))}
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        f = self._need()
        out = self._mapped(df.withColumn("_features", F.col("features")))
        out = out.withColumn("prediction", dot(vector_to_array("features"), F.array(*map(F.lit, f["w"]))) + f["b"])
        return out.withColumn("features", F.col("_features")).drop("_features")

    def state(self) -> dict:
        return {"fitted": self.fitted, "width": self.width, "gamma_": self.gamma_, "points": self.points}

    def _load_parts(self, path: str, spark: SparkSession, state: dict) -> None:
        self.fitted, self.width, self.gamma_, self.points = state["fitted"], state["width"], state["gamma_"], state.get("points")


class _Neighbours(Model):
    def __init__(self, n_neighbors: int = 5, weights: str = "uniform", metric: str = "euclidean"):
        self.n_neighbors, self.weights, self.metric = n_neighbors, weights, metric

    def fit(self, df: DataFrame) -> Model:
        self.fitted = numbered(df.where("label IS NOT NULL").select("label", vector_to_array("features").alias("v")), "id")
        return self

    def _near(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        q = numbered(df, "_id")
        ids = q.select(F.col("_id").alias("id"), vector_to_array("features").alias("v"))
        # ties go by id: of rows at one point, only the first n_neighbors can be among a query's nearest
        w = Window.partitionBy("v").orderBy("id")
        rows = self._need().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= self.n_neighbors).drop("_n")
        return q, neighbours.nearest(rows, ids, self.n_neighbors, "id", "v", self.metric, "label")

    def predict(self, df: DataFrame) -> DataFrame:
        q, near = self._near(df)
        return q.join(self._said(near), q["_id"] == F.col("q_id"), "left").drop("_id", "q_id")

    def _save_parts(self, path: str) -> None:
        self.fitted.write.mode("overwrite").parquet(f"{path}/rows")

    def _load_parts(self, path: str, spark: SparkSession, state: dict) -> None:
        self.fitted = spark.read.parquet(f"{path}/rows")


class KNNClassifier(_Neighbours, Classifier):
    def _said(self, near: DataFrame) -> DataFrame:
        return neighbours.knn_classify(near, self.weights)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return neighbours.knn_probabilities(self._near(df)[1], self.weights)


class KNNRegressor(_Neighbours, Regressor):
    def _said(self, near: DataFrame) -> DataFrame:
        return neighbours.knn_regress(near, self.weights)


class Clusterer(Model):
    task = "clustering"

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def score(self, df: DataFrame) -> float:
        """Silhouette of squared distances by the ML library, -1 with fewer than two clusters."""
        from pyspark.ml.evaluation import ClusteringEvaluator

        out = self.predict(df).where("prediction >= 0")
        return ClusteringEvaluator().evaluate(out) if out.select("prediction").distinct().count() > 1 else -1.0


class KMeans(_Library, Clusterer):
    """Restarts with seeds in a row; the lowest cost stays."""

    reader = mlk.KMeansModel

    def __init__(self, n_clusters: int = 8, max_iter: int = 300, tol: float = 1e-4, n_init: int = 10, init: str = "k-means++", random_state: int = SEED):
        self.n_clusters, self.max_iter, self.tol, self.n_init, self.init, self.random_state = n_clusters, max_iter, tol, n_init, init, random_state

    def fit(self, df: DataFrame) -> Model:
        rows = df.select("features").persist()
        mode = "random" if self.init == "random" else "k-means||"
        tries = [mlk.KMeans(k=self.n_clusters, maxIter=self.max_iter, tol=self.tol, initMode=mode, seed=self.random_state + i).fit(rows) for i in range(self.n_init)]
        rows.unpersist()
        self.fitted = min(tries, key=lambda m: m.summary.trainingCost)
        self.inertia_, self.n_iter_ = self.fitted.summary.trainingCost, self.fitted.summary.numIter
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self._need().transform(df)

    @property
    def cluster_centers_(self) -> list[list[float]]:
        return [[float(x) for x in c] for c in self._need().clusterCenters()]


class BisectingKMeans(_Library, Clusterer):
    """Hierarchical clusters from the top down: the largest cluster is cut in two until there are ``n_clusters``."""

    reader = mlk.BisectingKMeansModel

    def __init__(self, n_clusters: int = 2, max_iter: int = 20, min_size: float = 1.0, random_state: int = SEED):
        self.n_clusters, self.max_iter, self.min_size, self.random_state = n_clusters, max_iter, min_size, random_state

    def fit(self, df: DataFrame) -> Model:
        self.fitted = mlk.BisectingKMeans(k=self.n_clusters, maxIter=self.max_iter, minDivisibleClusterSize=self.min_size, seed=self.random_state).fit(df.select("features"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self._need().transform(df)


class DBSCAN(Clusterer):
    """Clusters of the rows it was fitted on; predict gives the cluster of the nearest core point within eps, or -1."""

    def __init__(self, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean"):
        self.eps, self.min_samples, self.metric = eps, min_samples, metric

    def fit(self, df: DataFrame) -> Model:
        x = vector_to_array("features")
        width = df.select(F.max(F.size(x))).head()[0] or 1
        rows = numbered(df.select(*(x[i].alias(f"x{i}") for i in range(width))), "id")
        axes = [f"x{i}" for i in range(width)]
        self.labels_ = neighbours.dbscan(rows, "id", axes, self.eps, self.min_samples, self.metric)
        self.fitted = self.labels_.where("is_core").join(rows, "id").select("id", F.array(*axes).alias("v"), F.col("cluster").alias("label")).persist()
        return self

    @property
    def n_clusters_(self) -> int:
        return self.labels_.where("cluster >= 0").select("cluster").distinct().count()

    @property
    def n_noise_(self) -> int:
        return self.labels_.where("cluster = -1").count()

    def predict(self, df: DataFrame) -> DataFrame:
        q = numbered(df, "_id")
        near = neighbours.nearest(self._need(), q.select(F.col("_id").alias("id"), vector_to_array("features").alias("v")), 1, "id", "v", self.metric, "label")
        near = near.where(F.col("distance") <= self.eps).select("q_id", "label")
        return q.join(near.withColumnRenamed("label", "_c"), q["_id"] == F.col("q_id"), "left").withColumn("prediction", F.coalesce("_c", F.lit(-1))).drop("_id", "q_id", "_c")

    def _save_parts(self, path: str) -> None:
        self.fitted.write.mode("overwrite").parquet(f"{path}/cores")

    def _load_parts(self, path: str, spark: SparkSession, state: dict) -> None:
        self.fitted = spark.read.parquet(f"{path}/cores")


def best_stump(df: DataFrame, feature: str, label: str, criterion: str = "gini", candidates: int = 10) -> DataFrame:
    """``threshold, impurity, n_left, n_right`` of the best split feature <= threshold, ties to the smallest.

    Thresholds are midpoints of neighbouring values if there are at most ``candidates``, else that many quantiles;
    every threshold is an aggregate of one pass (gini, entropy, mse), or of a pass over (threshold, side) groups (mae).
    """
    x, y = col(feature).cast("double"), col(label)
    rows = df.where(x.isNotNull() & y.isNotNull()).select(x.alias("x"), y.alias("y"))
    values = sorted(r[0] for r in rows.select("x").distinct().limit(candidates + 1).collect())
    if len(values) <= candidates:
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    else:
        q = rows.agg(F.percentile("x", F.array(*(F.lit(i / (candidates + 1)) for i in range(1, candidates + 1))))).head()[0]
        cuts = sorted(set(q))
    sides = rows.select("y", F.explode(F.array(*(F.struct(F.lit(c).alias("threshold"), (F.col("x") <= c).alias("left")) for c in cuts))).alias("s")).select("y", "s.*")
    g = ["threshold", "left"]
    if criterion in ("gini", "entropy"):
        c = sides.groupBy(*g, "y").agg(F.count("*").alias("n")).groupBy(*g).agg(F.sum("n").alias("n"), F.collect_list("n").alias("c"))
        p = F.transform("c", lambda v: v / F.col("n"))
        f = (lambda v: v * v) if criterion == "gini" else (lambda v: v * F.log2(v))
        s = F.aggregate(F.transform(p, f), F.lit(0.0), lambda a, v: a + v)
        each = c.select(*g, "n", (1 - s if criterion == "gini" else -s).alias("i"))
    elif criterion == "mse":
        each = sides.groupBy(*g).agg(F.count("*").alias("n"), F.var_pop("y").alias("i"))
    elif criterion == "mae":
        mid = sides.groupBy(*g).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y)").alias("m"))
        each = sides.join(F.broadcast(mid), g).groupBy(*g).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("m"))).alias("i"))
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    both = each.groupBy("threshold").agg((F.sum(F.col("n") * F.col("i")) / F.sum("n")).alias("impurity"), F.sum(F.when(F.col("left"), F.col("n")).otherwise(0)).alias("n_left"), F.sum(F.when(~F.col("left"), F.col("n")).otherwise(0)).alias("n_right"))
    return both.where("n_left > 0 AND n_right > 0").orderBy(F.round("impurity", 9), "threshold").limit(1)


REGISTRY: dict[str, type[Model]] = {
    c.__name__: c
    for c in (LinearRegression, Ridge, Lasso, DecisionTreeRegressor, RandomForestRegressor, BaggingRegressor, SVMRegressor, KNNRegressor, LogisticRegression, DecisionTreeClassifier, RandomForestClassifier, BaggingClassifier, SVMClassifier, KNNClassifier, KMeans, BisectingKMeans, DBSCAN)
}


def registry(task: str) -> dict[str, type[Model]]:
    return {n: c for n, c in REGISTRY.items() if c.task == task}
