"""Boosting of all folds in shared passes against a plain loop over the same bins."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, shared_boosting

FEATURES = ["f1", "f2", "f3"]
MIN_TRAIN, TEST = 100, 40


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    parts = []
    for name, n in (("a", 400), ("b", 260), (None, 230), ("short", 90)):
        x = rng.normal(size=(n, 3))
        x[:, 1] = np.round(x[:, 1], 1)  # many ties
        x[:, 2] = 4.0 if name == "b" else x[:, 2]
        y = (x[:, 0] * x[:, 1] + 0.4 * rng.normal(size=n) > 0).astype(int)
        y[:170] = 1 if name == "b" else y[:170]  # first folds of one class
        parts.append(pd.DataFrame({"series_id": name, "date": np.arange(n), "f1": x[:, 0], "f2": x[:, 1], "f3": x[:, 2], "target": y, "next_return": rng.normal(size=n)}))
    return spark.createDataFrame(pd.concat(parts), "series_id string, date int, f1 double, f2 double, f3 double, target int, next_return double")


def plain(frame: pd.DataFrame, trees: int, rate: float, depth: int, bins: int, embargo: int) -> dict:
    """(key, date) -> probability: each fold by itself, row by row masks, sums of floating numbers."""
    out = {}
    for key, part in frame.groupby("series_id", dropna=False):
        part = part.sort_values("date")
        x, y, n = part[FEATURES].to_numpy(), part["target"].to_numpy(float), len(part)
        starts = range(MIN_TRAIN, n - TEST, TEST)
        sizes = [max(0, s - embargo) for s in starts]
        early = x[: next((m for m in sizes if m), 0)]
        for start, m in zip(starts, sizes, strict=True):
            ahead = slice(start, start + TEST)
            if m == 0 or y[:m].min() == y[:m].max():
                p = np.full(TEST, y[:m].mean() if m else 0.5)
            else:
                edges = [[np.sort(v)[int(np.ceil(k * len(v) / bins)) - 1] for k in range(1, bins)] for v in early.T]
                code = np.array([[sum(e < v for e in edges[j]) for j, v in enumerate(row)] for row in x])
                score = np.full(n, np.log(y[:m].mean() / (1 - y[:m].mean())))
                for _ in range(trees):
                    q = 1 / (1 + np.exp(-score))
                    leaves = [np.ones(n, bool)]
                    for _ in range(depth):
                        leaves = [half for leaf in leaves for half in halves(code, leaf, m, y - q, bins)]
                    for leaf in leaves:
                        train = leaf & (np.arange(n) < m)
                        score[leaf] += rate * (y - q)[train].sum() / max((q * (1 - q))[train].sum(), 1e-12)
                p = 1 / (1 + np.exp(-score[ahead]))
            out.update({(None if pd.isna(key) else key, d): v for d, v in zip(part["date"].to_numpy()[ahead].tolist(), p, strict=True)})
    return out


def halves(code, leaf, m, residual, bins):
    train = leaf & (np.arange(len(leaf)) < m)
    best, found = 0.0, None
    for j in range(code.shape[1]):
        for b in range(bins):
            low, high = train & (code[:, j] <= b), train & (code[:, j] > b)
            if low.any() and high.any():
                gain = (residual[low].mean() - residual[high].mean()) ** 2 * low.sum() * high.sum()
                if gain > best * (1 + 1e-12):
                    best, found = gain, (j, b)
    return [leaf] if found is None else [leaf & (code[:, found[0]] <= found[1]), leaf & (code[:, found[0]] > found[1])]


def shown(df) -> dict:
    return {(r.series_id, r.date): r.probability for r in df.collect()}


@pytest.mark.parametrize(("embargo", "depth", "block_rows"), [(0, 2, 64), (30, 1, 4096), (110, 3, 100)])
def test_equals_a_plain_loop(frame, embargo, depth, block_rows):
    got = shared_boosting.walk_forward_predictions(frame, FEATURES, 5, 0.3, depth, 8, MIN_TRAIN, TEST, embargo, block_rows=block_rows, together=2)
    rows, got = got.count(), shown(got)
    want = plain(frame.toPandas(), 5, 0.3, depth, 8, embargo)
    assert got.keys() == want.keys() and rows == len(want) > 300
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7)


def test_blocks_and_jobs_change_nothing(frame, monkeypatch):
    make = lambda **how: shown(shared_boosting.walk_forward_predictions(frame, FEATURES, 4, min_train=MIN_TRAIN, test=TEST, **how))
    once = make(together=4)
    monkeypatch.setattr(shared_boosting, "HELD", 50)
    monkeypatch.setattr(shared_boosting, "BROADCAST_BYTES", 0)
    assert make(block_rows=37, together=3) == once


def test_close_to_exact_splits(frame):
    """Bins cost little against splits at every value."""
    some = frame.where("series_id = 'a'")
    scores = [models.auc(p).first()["auc"] for p in (
        shared_boosting.walk_forward_predictions(some, FEATURES, 12, 0.3, min_train=MIN_TRAIN, test=TEST, together=4),
        models.walk_forward_predictions(some, FEATURES, lambda: models.Boosting(12, 0.3), MIN_TRAIN, TEST),
    )]
    assert min(scores) > 0.7 and abs(scores[0] - scores[1]) < 0.06


def test_without_folds(frame):
    for some in (frame.where("series_id = 'short'"), frame.where(F.lit(False))):
        assert shared_boosting.walk_forward_predictions(some, FEATURES, 3, min_train=MIN_TRAIN, test=TEST).count() == 0
    with pytest.raises(ValueError, match="bins"):
        shared_boosting.walk_forward_predictions(frame, FEATURES, bins=300)
