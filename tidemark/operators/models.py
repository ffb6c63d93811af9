"""Classifiers, walk-forward validation and scoring.

Any object with ``fit(X, y)`` and ``predict_proba(X)`` can be validated; folds
of all series are fitted in parallel in grouped pandas functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators.folds import expanding_rows
from tidemark.operators.regimes import _keys_schema, filter_fold
from tidemark.sources import store

MIN_TRAIN, TEST = 800, 125


class Classifier(Protocol):
    """What a model must offer."""

    def fit(self, X: np.ndarray, y: np.ndarray) -> Classifier: ...

    def predict_proba(self, X: np.ndarray) -> np.ndarray: ...


class Logistic:
    """Standardised inputs and ridge logistic regression: minimises C times the summed loss plus half the squared weights, by Newton steps."""

    def __init__(self, C: float = 0.3, rounds: int = 60):
        self.C, self.rounds = C, rounds

    def fit(self, X, y) -> Logistic:
        X, y = np.asarray(X, float), np.asarray(y, float)
        self.mean, std = X.mean(axis=0), X.std(axis=0)
        self.std = np.where(std > 0, std, 1.0)
        a = np.column_stack((np.ones(len(X)), (X - self.mean) / self.std))
        ridge = np.append(0.0, np.ones(X.shape[1]))
        w = np.zeros(a.shape[1])
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
            grad = self.C * (a.T @ (p - y)) + ridge * w
            hess = self.C * (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-10)
            step = np.linalg.solve(hess, grad)
            w = w - step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-10:
                break
        self.w = w
        return self

    def predict_proba(self, X) -> np.ndarray:
        z = self.w[0] + (np.asarray(X, float) - self.mean) / self.std @ self.w[1:]
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return np.column_stack((1 - p, p))


class Boosting:
    """Gradient boosting of the logistic loss with small regression trees: exact splits on squared error, Newton leaf values."""

    def __init__(self, trees: int = 80, rate: float = 0.04, depth: int = 2):
        self.trees, self.rate, self.depth = trees, rate, depth

    def fit(self, X, y) -> Boosting:
        X, y = np.asarray(X, float), np.asarray(y, float)
        order = np.argsort(X, axis=0, kind="stable")
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        score, self.forest = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(X, order, y - p, p * (1 - p), np.ones(len(y), bool), self.depth)
            self.forest.append(tree)
            score = score + self.rate * self._value(tree, X)
        return self

    def _grow(self, X, order, residual, curve, inside, depth):
        n = int(inside.sum())
        leaf = float(residual[inside].sum() / max(curve[inside].sum(), 1e-12))
        if not depth or n < 2:
            return leaf
        rows = order[inside[order]].reshape(-1, X.shape[1]) if inside.all() else np.column_stack([order[inside[order[:, j]], j] for j in range(X.shape[1])])
        values = np.take_along_axis(X, rows, axis=0)
        sums = np.cumsum(residual[rows], axis=0)
        left = np.arange(1, n)[:, None]
        gain = (sums[:-1] / left - (sums[-1] - sums[:-1]) / (n - left)) ** 2 * left * (n - left)
        gain = np.where(values[1:] > values[:-1], gain, -1.0)
        at, j = divmod(int(gain.argmax()), X.shape[1])
        if gain[at, j] <= 0:
            return leaf
        cut = (values[at, j] + values[at + 1, j]) / 2
        low = inside & (X[:, j] <= cut)
        return j, cut, self._grow(X, order, residual, curve, low, depth - 1), self._grow(X, order, residual, curve, inside & ~low, depth - 1)

    def _value(self, tree, X) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(X), tree)
        j, cut, low, high = tree
        return np.where(X[:, j] <= cut, self._value(low, X), self._value(high, X))

    def predict_proba(self, X) -> np.ndarray:
        X = np.asarray(X, float)
        score = self.base + self.rate * sum(self._value(t, X) for t in self.forest)
        p = 1 / (1 + np.exp(-score))
        return np.column_stack((1 - p, p))


class Constant:
    """The share of the positive class; takes the place of a model where training rows are of one class."""

    def fit(self, X, y) -> Constant:
        self.p = float(np.mean(y)) if len(y) else 0.5
        return self

    def predict_proba(self, X) -> np.ndarray:
        return np.tile([1 - self.p, self.p], (len(X), 1))


def candidate_models() -> dict[str, Callable[[], Classifier]]:
    return {"logistic_regression": Logistic, "gradient_boosting": Boosting}


def _fitted(make: Callable[[], Classifier], X: np.ndarray, y: np.ndarray) -> Classifier:
    return (make() if len(np.unique(y)) > 1 else Constant()).fit(X, y)


@dataclass(frozen=True)
class Validation:
    """Predictions and pooled metrics (keys, auc, accuracy, n) of a model."""

    name: str
    metrics: DataFrame
    predictions: DataFrame


def walk_forward_predictions(frame: DataFrame, features: list[str], make: Callable[[], Classifier] = Logistic, min_train: int = MIN_TRAIN, test: int = TEST, embargo: int = 0, by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, order, fold, next_return, target, probability of all test rows. A series too short for a fold gives none."""
    rows = expanding_rows(frame.select(*by, order, *features, "target", "next_return"), min_train, test, embargo, by, order)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        train, ahead = part[~part["is_test"]], part[part["is_test"]]
        model = _fitted(make, train[features].to_numpy(float), train["target"].to_numpy())
        out = ahead[[*by, order, "fold", "next_return", "target"]].copy()
        out["probability"] = model.predict_proba(ahead[features].to_numpy(float))[:, 1]
        return out

    return rows.groupBy(*by, "fold").applyInPandas(one, f"{_keys_schema(rows, by, order)}, fold int, next_return double, target int, probability double")


def regime_conditioned_predictions(
    frame: DataFrame, features: list[str], make: Callable[[], Classifier] = Logistic, min_train: int = MIN_TRAIN, test: int = TEST, n_states: int = 3, seed: int = 0,
    min_rows: int = 50, r: str = "return", by=ts.KEYS, order: str = "date",
) -> DataFrame:
    """As ``walk_forward_predictions``, with a model for each inferred state that has ``min_rows`` training rows; others use the fold's pooled model."""
    columns = list(dict.fromkeys([*features, r]))
    rows = expanding_rows(frame.select(*by, order, *columns, "target", "next_return"), min_train, test, 0, by, order)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row").reset_index(drop=True)
        n = int((~part["is_test"]).sum())
        X, y = part[features].to_numpy(float), part["target"].to_numpy()
        state = filter_fold(part[r].to_numpy(float), n, n_states, seed).argmax(axis=1)
        p = _fitted(make, X[:n], y[:n]).predict_proba(X[n:])[:, 1]
        for k in range(n_states):
            mine, ahead = state[:n] == k, state[n:] == k
            if mine.sum() >= min_rows and ahead.any():
                p[ahead] = _fitted(make, X[:n][mine], y[:n][mine]).predict_proba(X[n:][ahead])[:, 1]
        return part.iloc[n:][[*by, order, "fold", "next_return", "target"]].assign(probability=p)

    return rows.groupBy(*by, "fold").applyInPandas(one, f"{_keys_schema(rows, by, order)}, fold int, next_return double, target int, probability double")


# --- metrics ----------------------------------------------------------------


def auc(df: DataFrame, score: str = "probability", target: str = "target", by=ts.KEYS) -> DataFrame:
    """keys, n, positives, auc: the rank form, ties counted half; NULL where a class is missing.

    Ranks come from the distinct scores' counts, so a score shared by many rows is one row before the window.
    """
    some = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    levels = some.groupBy(*by, score).agg(F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    w = ts.spec(by, score)
    below = F.sum("_n").over(w) - F.col("_n")
    ranked = levels.select(*by, "_p", "_n", (F.col("_p") * (below + (F.col("_n") + 1) / 2.0)).alias("_r"))
    total = ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_p").alias("positives"), F.sum("_r").alias("_r"))
    p, q = F.col("positives").cast("double"), (F.col("n") - F.col("positives")).cast("double")
    return total.select(*by, "n", "positives", ts.ratio(F.col("_r") - p * (p + 1) / 2.0, p * q).alias("auc"))


def accuracy(score: Column | str = "probability", target: Column | str = "target") -> Column:
    """Aggregate: share of rows whose class at 0.5 is the target."""
    return F.avg(((ts.as_col(score) >= 0.5).cast("int") == ts.as_col(target)).cast("double"))


def validate(name: str, predictions: DataFrame, by=ts.KEYS) -> Validation:
    scores = auc(predictions, by=by).select(*by, "n", "auc").join(predictions.groupBy(*by).agg(accuracy().alias("accuracy")), list(by))
    return Validation(name, scores.withColumn("model", F.lit(name)), predictions)


def walk_forward_validate(frame: DataFrame, features: list[str], name: str, make: Callable[[], Classifier], min_train: int = MIN_TRAIN, test: int = TEST, embargo: int = 0, by=ts.KEYS, order: str = "date") -> Validation:
    """Raises if no series is long enough for a fold. The predictions are written, as scores and callers read them again."""
    predictions = store.written(walk_forward_predictions(frame, features, make, min_train, test, embargo, by, order), "predictions")
    if predictions.isEmpty():
        raise ValueError(f"no fold: a series needs more than {min_train + test} rows")
    return validate(name, predictions, by)


def choose_best(results: list[Validation]) -> Validation:
    """The highest (auc, accuracy); of equals the first. One row for each result is read."""
    if not results:
        raise ValueError("nothing to choose from")
    scores = [r.metrics.agg(F.avg("auc").alias("auc"), F.avg("accuracy").alias("accuracy")).first() for r in results]
    return results[max(range(len(results)), key=lambda i: (scores[i]["auc"] or 0.0, scores[i]["accuracy"] or 0.0, -i))]


def best_model(metrics: DataFrame) -> DataFrame:
    """The row with the highest (auc, accuracy) of a metrics frame; of equals the first model by name."""
    return metrics.orderBy(F.desc("auc"), F.desc("accuracy"), "model").limit(1)
