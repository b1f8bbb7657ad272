"""Models over walk-forward segments.

Linear models come from sums of products, which Spark adds up by segment in one aggregation; the
small systems are solved where each segment's sums lie.  Other models are adapters that are fitted
on a segment's rows in one task, which holds the numbers of one segment at a time.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.panel import Panel
from .walkforward import SegmentPlan, resolve, windows


class ModelAdapter(ABC):
    """fit and predict on arrays; a fresh copy is made for every segment."""

    @abstractmethod
    def fit(self, x: np.ndarray, y: np.ndarray | None, weight: np.ndarray | None = None) -> None: ...

    @abstractmethod
    def predict(self, x: np.ndarray) -> np.ndarray: ...

    def partial_fit(self, x, y, weight=None) -> None:
        self.fit(x, y, weight)

    def get_state(self) -> dict:
        return dict(self.__dict__)

    def load_state(self, state: dict) -> None:
        self.__dict__.update(state)


@dataclass
class Linear(ModelAdapter):
    """Least squares, with a ridge penalty on all but the intercept."""

    alpha: float = 0.0
    fit_intercept: bool = True

    def fit(self, x, y, weight=None):
        w = np.ones(len(x)) if weight is None else weight
        z = np.column_stack([np.ones(len(x)), x]) if self.fit_intercept else x
        self.coef = solve(z.T @ (z * w[:, None]), z.T @ (w * y), self.alpha, self.fit_intercept)

    def predict(self, x):
        return x @ self.coef[1:] + self.coef[0] if self.fit_intercept else x @ self.coef


@dataclass
class Lasso(ModelAdapter):
    """Squared error / 2n + alpha * (ratio * L1 + (1 - ratio) / 2 * L2), by coordinate descent."""

    alpha: float = 1.0
    l1_ratio: float = 1.0
    rounds: int = 1000

    def fit(self, x, y, weight=None):
        w = np.ones(len(x)) / len(x) if weight is None else weight / weight.sum()
        mx, my = w @ x, w @ y
        z, r = x - mx, y - my
        self.coef, scale = np.zeros(x.shape[1]), w @ (z * z)
        for _ in range(self.rounds):
            before = self.coef.copy()
            for j in np.flatnonzero(scale):
                rho = (w * z[:, j]) @ r + scale[j] * self.coef[j]
                new = np.sign(rho) * max(abs(rho) - self.alpha * self.l1_ratio, 0) / (scale[j] + self.alpha * (1 - self.l1_ratio))
                r -= z[:, j] * (new - self.coef[j])
                self.coef[j] = new
            if np.abs(self.coef - before).max(initial=0) < 1e-10:
                break
        self.intercept = my - mx @ self.coef

    def predict(self, x):
        return x @ self.coef + self.intercept


@dataclass
class Logistic(ModelAdapter):
    """Class probability by Newton steps with penalty 1 / c."""

    c: float = 1.0
    rounds: int = 50

    def fit(self, x, y, weight=None):
        z, w = np.column_stack([np.ones(len(x)), x]), np.ones(len(x)) if weight is None else weight
        self.coef = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], 1 / self.c)
        ridge[0] = 1e-9
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ self.coef, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (w * (y - p)) - ridge * self.coef)
            self.coef += step
            if np.abs(step).max() < 1e-9:
                break

    def predict(self, x):
        return 1 / (1 + np.exp(-np.clip(x @ self.coef[1:] + self.coef[0], -30, 30)))


#: Cuts of a tree's node that are weighed at once.
CUTS = 1 << 16


@dataclass
class Tree(ModelAdapter):
    """A regression tree by least squares; ``trees`` over 1: boosted with ``rate``."""

    max_depth: int = 3
    min_leaf: int = 5
    trees: int = 1
    rate: float = 1.0

    def fit(self, x, y, weight=None):
        w = np.ones(len(x)) if weight is None else weight
        self.base = 0.0 if self.trees == 1 else float(np.average(y, weights=w))
        rest, self.nodes = y - self.base, []
        for _ in range(self.trees):
            tree = self._grow(x, rest, w, self.max_depth)
            self.nodes.append(tree)
            rest = rest - self.rate * self._walk(tree, x)

    def _grow(self, x, y, w, depth):
        value = float(np.average(y, weights=w))
        best = None
        if depth and len(y) >= 2 * self.min_leaf:
            for j in range(x.shape[1]):
                order = np.argsort(x[:, j], kind="stable")
                v, cw, cy = x[order, j], np.cumsum(w[order]), np.cumsum((w * y)[order])
                # blocks of cuts, so that what is made of them is small beside the rows
                for at in range(self.min_leaf, len(y) - self.min_leaf + 1, CUTS):
                    cut = np.arange(at, min(at + CUTS, len(y) - self.min_leaf + 1))
                    cut = cut[v[cut - 1] < v[cut]]
                    if len(cut):
                        gain = cy[cut - 1] ** 2 / cw[cut - 1] + (cy[-1] - cy[cut - 1]) ** 2 / (cw[-1] - cw[cut - 1])
                        k = int(np.argmax(gain))
                        if best is None or gain[k] > best[0]:
                            best = (gain[k], j, (v[cut[k] - 1] + v[cut[k]]) / 2)
        if best is None or best[0] <= np.sum(w * y) ** 2 / w.sum() + 1e-12:
            return value
        _, j, at = best
        order = v = cw = cy = cut = gain = None  # not held while the sides grow
        left = x[:, j] <= at
        return (j, at, self._grow(x[left], y[left], w[left], depth - 1), self._grow(x[~left], y[~left], w[~left], depth - 1))

    def _walk(self, node, x):
        if not isinstance(node, tuple):
            return np.full(len(x), node)
        j, at, a, b = node
        left = x[:, j] <= at
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(a, x[left]), self._walk(b, x[~left])
        return out

    def predict(self, x):
        return self.base + sum((self.rate if self.trees > 1 else 1.0) * self._walk(t, x) for t in self.nodes)


@dataclass
class Forest(Tree):
    """The mean of trees on resampled rows."""

    trees: int = 20
    seed: int = 0

    def fit(self, x, y, weight=None):
        w, r = np.ones(len(x)) if weight is None else weight, np.random.default_rng(self.seed)
        picks = [r.integers(0, len(x), len(x)) for _ in range(self.trees)]
        self.nodes = [self._grow(x[i], y[i], w[i], self.max_depth) for i in picks]

    def predict(self, x):
        return np.mean([self._walk(t, x) for t in self.nodes], axis=0)


@dataclass
class BoostedClasses(Tree):
    """Boosted trees on the log-odds of classes 0 and 1; predicts the probability of 1."""

    trees: int = 50
    rate: float = 0.1

    def fit(self, x, y, weight=None):
        w = np.ones(len(x)) if weight is None else weight
        p = float(np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6))
        self.base, self.nodes = float(np.log(p / (1 - p))), []
        z = np.full(len(x), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            h = np.maximum(q * (1 - q), 1e-9)
            tree = self._grow(x, (y - q) / h, w * h, self.max_depth)  # Newton steps as leaf values
            self.nodes.append(tree)
            z = z + self.rate * self._walk(tree, x)

    def predict(self, x):
        z = self.base + sum(self.rate * self._walk(t, x) for t in self.nodes)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Neighbors(ModelAdapter):
    """The mean label of the k nearest training rows; of rows as far the earlier ones.  For classes
    0 and 1 that is the share of class 1."""

    k: int = 5

    def fit(self, x, y, weight=None):
        self.x, self.y = x, y
        self.w = np.ones(len(x)) if weight is None else weight

    def predict(self, x):
        out = np.empty(len(x))
        for a in range(0, len(x), 512):
            gap = ((x[a : a + 512, None, :] - self.x[None, :, :]) ** 2).sum(axis=2)
            near = np.argsort(gap, axis=1, kind="stable")[:, : self.k]
            out[a : a + 512] = np.average(self.y[near], weights=self.w[near], axis=1)
        return out


@dataclass
class Margin(ModelAdapter):
    """A linear support vector machine with squared hinge loss (classes 0 and 1), or with squared
    loss outside ``epsilon`` (regression), by Newton steps on the rows that count."""

    c: float = 1.0
    epsilon: float | None = None
    rounds: int = 100

    def fit(self, x, y, weight=None):
        w = np.ones(len(x)) if weight is None else weight
        z, self.coef = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
        ridge = np.eye(z.shape[1]) / (2 * self.c)
        ridge[0, 0] = 1e-9
        sign = np.where(y > 0.5, 1.0, -1.0)
        for _ in range(self.rounds):
            f = z @ self.coef
            if self.epsilon is None:
                on, goal = sign * f < 1, sign
            else:
                on, goal = np.abs(y - f) > self.epsilon, y - np.sign(y - f) * self.epsilon
            new = np.linalg.solve((z[on] * w[on, None]).T @ z[on] + ridge, (z[on] * w[on, None]).T @ goal[on])
            done = np.abs(new - self.coef).max() < 1e-9
            self.coef = new
            if done:
                break

    def predict(self, x):
        f = x @ self.coef[1:] + self.coef[0]
        return f if self.epsilon is not None else (f > 0).astype(float)


class Foreign(ModelAdapter):
    """Any object with fit and predict; with ``probability``, that column of predict_proba (counted
    from 0, the last one for True).  ``make`` gives a fresh one for each segment."""

    def __init__(self, make: Callable[[], object], probability: int | bool | None = None):
        self.estimator, self.probability = make(), probability

    def fit(self, x, y, weight=None):
        if weight is None:
            self.estimator.fit(x, y)
        else:
            self.estimator.fit(x, y, sample_weight=weight)

    def predict(self, x):
        if self.probability is None or self.probability is False:
            return np.asarray(self.estimator.predict(x), float).ravel()
        p = np.asarray(self.estimator.predict_proba(x), float)
        column = p.shape[1] - 1 if self.probability is True else self.probability
        if not 0 <= column < p.shape[1]:
            raise ValueError(f"no column {column} among {p.shape[1]} probabilities")
        return p[:, column]


MODELS: dict[str, Callable[..., ModelAdapter]] = {
    "LinearRegression": lambda fit_intercept=True: Linear(0.0, fit_intercept), "Ridge": lambda alpha=1.0, fit_intercept=True: Linear(alpha, fit_intercept),
    "Lasso": Lasso, "ElasticNet": lambda alpha=1.0, l1_ratio=0.5: Lasso(alpha, l1_ratio), "LogisticRegression": lambda C=1.0: Logistic(C),
    "DecisionTreeRegressor": Tree, "RandomForestRegressor": lambda n_estimators=20, max_depth=6, random_state=0: Forest(max_depth, trees=n_estimators, seed=random_state),
    "GradientBoostingRegressor": lambda n_estimators=50, max_depth=3, learning_rate=0.1: Tree(max_depth, trees=n_estimators, rate=learning_rate),
    "DecisionTreeClassifier": Tree, "RandomForestClassifier": lambda n_estimators=20, max_depth=6, random_state=0: Forest(max_depth, trees=n_estimators, seed=random_state),
    "GradientBoostingClassifier": lambda n_estimators=50, max_depth=3, learning_rate=0.1: BoostedClasses(max_depth, trees=n_estimators, rate=learning_rate),
    "KNeighborsRegressor": lambda n_neighbors=5: Neighbors(n_neighbors), "KNeighborsClassifier": lambda n_neighbors=5: Neighbors(n_neighbors),
    "LinearSVC": lambda C=1.0: Margin(C), "LinearSVR": lambda C=1.0, epsilon=0.0: Margin(C, epsilon),
}


def create_model(name: str, params: dict | None = None) -> ModelAdapter:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(MODELS)}")
    return MODELS[name](**(params or {}))


def solve(a: np.ndarray, b: np.ndarray, alpha: float = 0.0, intercept: bool = True) -> np.ndarray:
    ridge = alpha * np.eye(len(a))
    if intercept:
        ridge[0, 0] = 0
    return np.linalg.lstsq(a + ridge, b, rcond=None)[0]


@dataclass
class ModelRunner:
    """Trains on each segment's training rows and predicts its inference rows.

    Rows with a missing feature are neither trained on nor predicted; rows with a missing label
    are not trained on (``zero_labels``: they count as 0).  Predictions that overlap are resolved
    by the policy; a missing one never replaces another.
    """

    model: str | Callable[[], ModelAdapter]
    features: list[str]
    label: str | None
    params: dict | None = None
    output: str = "pred"
    overlap_policy: str = "last"
    weight: str | None = None
    zero_labels: bool = False
    closed: str = "both"

    def segments(self, panel: Panel, plan: SegmentPlan) -> DataFrame:
        """Predictions by segment, asset and time."""
        linear = self.model in ("LinearRegression", "Ridge")
        return self._linear(panel, plan) if linear else self._grouped(panel, plan)

    def run(self, panel: Panel, plan: SegmentPlan) -> DataFrame:
        return resolve(self.segments(panel, plan), [panel.asset, panel.time], [self.output], self.overlap_policy)

    def _rows(self, panel: Panel, plan: SegmentPlan, part: str) -> DataFrame:
        df = windows(panel, plan, part, self.closed).dropna(subset=self.features)
        if part == "train" and self.label:
            df = df.withColumn("__y", F.coalesce(F.col(self.label).cast("double"), F.lit(0.0) if self.zero_labels else F.lit(None))).where("__y is not null")
        return df

    def _linear(self, panel: Panel, plan: SegmentPlan) -> DataFrame:
        params = {"alpha": 1.0, **(self.params or {})} if self.model == "Ridge" else dict(self.params or {})
        intercept, alpha = params.get("fit_intercept", True), params.get("alpha", 0.0)
        z = [F.lit(1.0)] * intercept + [F.col(c).cast("double") for c in self.features]
        w = F.col(self.weight) if self.weight else F.lit(1.0)
        k = len(z)
        sums = [F.sum(w * z[i] * z[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i + 1)] + [F.sum(w * z[i] * F.col("__y")).alias(f"b{i}") for i in range(k)]
        moments = self._rows(panel, plan, "train").groupBy("segment").agg(*sums)

        def run(batches):
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    a = np.array([[row[f"a{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
                    out.append(solve(a, np.array([row[f"b{i}"] for i in range(k)]), alpha, intercept).tolist())
                yield pd.DataFrame({"segment": pdf["segment"], "__c": out})

        # one row a segment: as small as the plan
        fitted = F.broadcast(moments.mapInPandas(run, "segment int, __c array<double>"))
        value = sum((z[i] * F.col("__c")[i] for i in range(1, k)), z[0] * F.col("__c")[0])
        return self._rows(panel, plan, "infer").join(fitted, "segment").select("segment", panel.asset, panel.time, value.alias(self.output))

    def _grouped(self, panel: Panel, plan: SegmentPlan) -> DataFrame:
        make = (lambda: create_model(self.model, self.params)) if isinstance(self.model, str) else self.model
        output, asset, time, k, label, weight = self.output, panel.asset, panel.time, len(self.features), bool(self.label), bool(self.weight)
        keys = {f.name: f.dataType.simpleString() for f in panel.df.schema.fields}
        numbers = [f"__x{i}" for i in range(k)] + ["__y", "__w"][: 1 + weight]

        def table(b: pa.RecordBatch, n: int) -> np.ndarray:
            return np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in numbers[:n]])

        def predicted(train: list[np.ndarray], infer: list[pa.RecordBatch]):
            if not infer:
                return
            values = np.full(sum(b.num_rows for b in infer), np.nan)
            if train:
                rows = np.concatenate(train)
                train.clear()
                model = make()
                model.fit(rows[:, :k], rows[:, k] if label else None, rows[:, k + 1] if weight else None)
                values[:] = model.predict(np.concatenate([table(b, k) for b in infer]))
            at = 0
            for b in infer:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(values[at : at + b.num_rows], pa.float64())], names=["segment", asset, time, output])
                at += b.num_rows

        def run(batches):
            """Rows by segment, training rows first."""
            segment, train, infer = None, [], []
            for b in batches:
                own, part = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("segment", "__infer"))
                ends = [*(np.flatnonzero((own[1:] != own[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), b.num_rows]
                for a, z in zip([0, *ends], ends):
                    if z > a and own[a] != segment:
                        yield from predicted(train, infer)
                        segment, train, infer = own[a], [], []
                    if z > a and part[a]:
                        infer.append(b.slice(a, z - a))
                    elif z > a:
                        train.append(table(b.slice(a, z - a), len(numbers)))
            yield from predicted(train, infer)

        number = lambda c: F.col(c).cast("double")
        x = [number(c).alias(n) for c, n in zip(self.features, numbers)] + ([number(self.weight).alias("__w")] if weight else [])
        none = F.lit(None).cast("double")
        train = self._rows(panel, plan, "train").select("segment", *[F.lit(None).cast(keys[c]).alias(c) for c in (asset, time)], *x, number("__y").alias("__y") if label else none.alias("__y"), F.lit(False).alias("__infer"))
        infer = self._rows(panel, plan, "infer").select("segment", asset, time, *x, none.alias("__y"), F.lit(True).alias("__infer"))
        schema = f"segment int, `{asset}` {keys[asset]}, `{time}` {keys[time]}, `{output}` double"
        got = train.unionByName(infer).repartition("segment").sortWithinPartitions("segment", "__infer").mapInArrow(run, schema)
        return got.withColumn(output, F.when(~F.isnan(output), F.col(output)))


def information_coefficient(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """Correlation of a score with a label at each time or asset."""
    both = F.col(score).isNotNull() & F.col(label).isNotNull()
    return df.groupBy(by).agg(F.corr(F.when(both, F.col(score)), F.when(both, F.col(label))).alias("ic"), F.sum(both.cast("long")).alias("n"))
