"""Hidden regimes: filter, EM fit, alignment, detection lag, walk-forward posteriors.

Recursions and fits run in grouped pandas functions, one group for a series or
for a fold of a series, so series and folds are parallel; scoring is relational.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import blocks
from tidemark.operators.folds import expanding_rows
from tidemark.sources import store

FLOOR, MAX_LAG = 1e-300, 30


# --- numerics on one series -------------------------------------------------


def stationary_distribution(transition: np.ndarray) -> np.ndarray:
    """The distribution that a chain keeps, by least squares."""
    p = np.asarray(transition, float)
    n = p.shape[0]
    system = np.vstack((p.T - np.eye(n), np.ones((1, n))))
    return np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0]


def densities(r: np.ndarray, means: np.ndarray, stds: np.ndarray) -> np.ndarray:
    z = (np.asarray(r, float)[:, None] - means) / stds
    return np.exp(-0.5 * z * z) / (stds * np.sqrt(2 * np.pi))


def filter_from(like: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filtered probabilities, marginals) of the rows of ``like`` after a state ``start``; a marginal below the floor is raised to it."""
    out, marginals = np.empty_like(like), np.empty(like.shape[0])
    move, now = np.asarray(transition, float).T.copy(), start
    for t in range(like.shape[0]):
        joint = move.dot(now) * like[t]
        marginals[t] = max(float(joint.sum()), FLOOR)
        now = joint / marginals[t]
        out[t] = now
    return out, marginals


def block_product(m: np.ndarray) -> np.ndarray:
    """The product m[-1] ... m[1] m[0] to a scale, by pairs: half as many matrices in each of log2(n) rounds, each brought to a sum of 1."""
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate((np.matmul(m[1 : len(m) - len(odd) : 2], m[0 : len(m) - len(odd) : 2]), odd))
        m = m / np.maximum(m.sum(axis=(1, 2), keepdims=True), FLOOR)
    return m[0]


def filter_states(r: np.ndarray, transition: np.ndarray, means: np.ndarray, stds: np.ndarray) -> tuple[np.ndarray, float]:
    """(filtered probabilities, log-likelihood). The stationary start is moved one step before the first update; a marginal below the floor is raised to it."""
    out, marginals = filter_from(densities(r, means, stds), transition, stationary_distribution(transition))
    return out, float(np.log(marginals).sum())


def _prefix_products(m: np.ndarray) -> np.ndarray:
    """Normalised running products of a stack of matrices, by doubling: log2(n) batched multiplications."""
    out = m / m.sum(axis=(1, 2), keepdims=True)
    step = 1
    while step < out.shape[0]:
        out[step:] = np.matmul(out[:-step], out[step:])
        out /= np.maximum(out.sum(axis=(1, 2), keepdims=True), FLOOR)
        step *= 2
    return out


def smooth(like: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(posteriors, expected transition counts, log-likelihood) of a chain whose first state follows ``start``."""
    like = np.maximum(like, FLOOR)
    first = start * like[0]
    if like.shape[0] == 1:
        return (first / first.sum())[None], np.zeros_like(transition), float(np.log(first.sum()))
    steps = transition[None] * like[1:, None, :]
    ahead = first @ _prefix_products(steps)
    forward = np.vstack((first, ahead))
    forward /= forward.sum(axis=1, keepdims=True)
    # Products from the right: transpose, reverse, run forward, reverse again.
    behind = _prefix_products(steps[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1).sum(axis=2)
    backward = np.vstack((behind, np.ones(transition.shape[0])))
    posterior = forward * backward
    posterior /= posterior.sum(axis=1, keepdims=True)
    pair = forward[:-1, :, None] * steps * backward[1:, None, :]
    pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), FLOOR)
    total = np.log(first.sum()) + np.log(np.maximum((forward[:-1] @ transition * like[1:]).sum(axis=1), FLOOR)).sum()
    return posterior, pair.sum(axis=0), float(total)


def fit_hmm(r: np.ndarray, n_states: int = 3, rounds: int = 200, tol: float = 1e-4, seed: int = 0) -> dict:
    """Gaussian hidden Markov model by EM: start, transition, means, stds, states by ascending mean.

    States start from bands of absolute deviation, so that volatility regimes
    are told apart; the seed shakes them slightly. Fewer rows than twice the states raise an error.
    """
    r = np.asarray(r, float)
    if r.size < 2 * n_states:
        raise ValueError("too few returns for this number of states")
    rng = np.random.default_rng(seed)
    spread = np.abs(r - r.mean())
    edges = np.quantile(spread, np.linspace(0, 1, n_states + 1)[1:-1])
    band = np.searchsorted(edges, pd.Series(spread).rolling(9, center=True, min_periods=1).mean().to_numpy())
    floor = max(r.std() * 1e-3, 1e-12)
    means = np.array([r[band == k].mean() if (band == k).any() else r.mean() for k in range(n_states)]) + rng.normal(0, 1e-3, n_states) * r.std()
    stds = np.array([max(r[band == k].std(), floor) if (band == k).sum() > 1 else r.std() + floor for k in range(n_states)])
    transition = np.full((n_states, n_states), 0.1 / max(1, n_states - 1))
    np.fill_diagonal(transition, 0.9 if n_states > 1 else 1.0)
    start, last = np.full(n_states, 1 / n_states), -np.inf
    for _ in range(rounds):
        posterior, moves, total = smooth(densities(r, means, stds), start, transition)
        weight = posterior.sum(axis=0) + 1e-12
        means = posterior.T @ r / weight
        stds = np.maximum(np.sqrt((posterior * (r[:, None] - means) ** 2).sum(axis=0) / weight), floor)
        transition = (moves + 1e-6) / (moves + 1e-6).sum(axis=1, keepdims=True)
        start = posterior[0]
        if total - last < tol * max(1.0, abs(total)) * 1e-2:
            break
        last = total
    order = np.argsort(means)
    return {"start": start[order], "transition": transition[np.ix_(order, order)], "means": means[order], "stds": stds[order]}


def assignment(gain: np.ndarray) -> np.ndarray:
    """Column of each row of a square matrix, all different, with the largest total gain.

    Hungarian method with potentials: rows are placed one after the other, each
    along the cheapest path of exchanges, in K^3 steps. Of equal totals the one
    found is a function of the matrix.
    """
    cost = gain.max() - np.asarray(gain, float) if gain.size else np.zeros((0, 0))
    k = cost.shape[0]
    row_price, column_price = np.zeros(k + 1), np.zeros(k + 1)
    taken_by = np.full(k + 1, -1)  # row of each column; the last column is the one outside
    for row in range(k):
        taken_by[k] = row
        column, least = k, np.full(k, np.inf)
        came, seen = np.full(k, k), np.zeros(k + 1, bool)
        while taken_by[column] >= 0:
            seen[column] = True
            here = taken_by[column]
            free = ~seen[:k]
            reduced = cost[here] - row_price[here] - column_price[:k]
            better = free & (reduced < least)
            least[better], came[better] = reduced[better], column
            nearest = int(np.where(free, least, np.inf).argmin())
            step = least[nearest]
            row_price[taken_by[seen]] += step
            column_price[seen] -= step
            least[free] -= step
            column = nearest
        while column != k:  # the path back gives each column to the row before it
            taken_by[column] = taken_by[came[column]]
            column = came[column]
    out = np.empty(k, int)
    out[taken_by[:k]] = np.arange(k)
    return out


def align_states(confusion: np.ndarray) -> dict[int, int]:
    """inferred -> true labels with the most agreement."""
    return dict(enumerate(assignment(confusion).tolist()))


# --- on frames --------------------------------------------------------------


def _keys_schema(df: DataFrame, by: Sequence[str], *more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in (*by, *more))


def hamilton_filter(df: DataFrame, transition, means, stds, r: str = "return", by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, order, probabilities (array), log_likelihood up to the row."""
    transition, means, stds = (np.asarray(x, float) for x in (transition, means, stds))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        values = frame[r].to_numpy(float)
        probabilities, _ = filter_states(values, transition, means, stds)
        start = stationary_distribution(transition)
        before = np.vstack((start, probabilities[:-1])) @ transition
        marginal = np.maximum((before * densities(values, means, stds)).sum(axis=1), FLOOR)
        out = frame[[*by, order]].copy()
        out["probabilities"] = list(probabilities)
        out["log_likelihood"] = np.cumsum(np.log(marginal))
        return out

    some = df.where(F.col(r).isNotNull()).select(*by, order, r)
    return some.groupBy(*by).applyInPandas(one, f"{_keys_schema(some, by, order)}, probabilities array<double>, log_likelihood double")


def hamilton_filter_in_blocks(
    df: DataFrame, transition, means, stds, r: str = "return", by=ts.KEYS, order: str = "date", block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """The rows of ``hamilton_filter``, a series dealt to several tasks.

    One update multiplies the state by a K x K matrix, and products of those are
    associative: each block is reduced to one scaled product, the products (one
    for each block) carry the start of each block on, and each block is filtered
    from its own start.
    """
    transition, means, stds = (np.asarray(x, float) for x in (transition, means, stds))
    k = len(means)
    some = df.where(F.col(r).isNotNull()).select(*by, order, r)
    rows = store.written(blocks.in_blocks(blocks.positioned(some, by, [order]), block_rows), "filter-rows")
    keys = _keys_schema(rows, by)

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        like = densities(frame.sort_values(blocks.POS)[r].to_numpy(float), means, stds)
        out = frame[[*by, blocks.BLOCK]].iloc[:1].copy()
        out["product"] = [block_product(like[:, :, None] * transition.T).ravel()]
        return out

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(blocks.BLOCK)
        now, starts = stationary_distribution(transition), []
        for matrix in frame["product"]:
            starts.append(now)
            now = np.reshape(matrix, (k, k)) @ now
            now = now / max(float(now.sum()), FLOOR)
        out = frame[[*by, blocks.BLOCK]].copy()
        out["start"] = starts
        return out

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(blocks.POS)
        probabilities, marginals = filter_from(densities(frame[r].to_numpy(float), means, stds), transition, np.asarray(frame["start"].iloc[0]))
        out = frame[[*by, order, blocks.POS, blocks.BLOCK]].copy()
        out["probabilities"] = list(probabilities)
        out["log_marginal"] = np.log(marginals)
        return out

    place = f"{blocks.BLOCK} long"
    products = rows.groupBy(*by, blocks.BLOCK).applyInPandas(product, f"{keys}, {place}, product array<double>")
    starts = products.groupBy(*by).applyInPandas(carry, f"{keys}, {place}, start array<double>")
    filtered = rows.join(starts, [*by, blocks.BLOCK]).groupBy(*by, blocks.BLOCK).applyInPandas(
        run, f"{_keys_schema(rows, by, order)}, {blocks.POS} long, {place}, probabilities array<double>, log_marginal double"
    )
    filtered = store.written(filtered, "filtered")
    return blocks.running(filtered, {"log_likelihood": (blocks.SUM, "log_marginal")}, by).select(*by, order, "probabilities", "log_likelihood")


def hmm_parameters(df: DataFrame, n_states: int = 3, seed: int = 0, r: str = "return", by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, state (by ascending mean), mean, std, transition (array)."""
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        model = fit_hmm(frame.sort_values(order)[r].to_numpy(float), n_states, seed=seed)
        out = pd.concat([frame[[*by]].iloc[:1]] * n_states, ignore_index=True)
        return out.assign(state=range(n_states), mean=model["means"], std=model["stds"], transition=list(model["transition"]))

    some = df.where(F.col(r).isNotNull()).select(*by, order, r)
    return some.groupBy(*by).applyInPandas(one, f"{_keys_schema(some, by)}, state int, mean double, std double, transition array<double>")


def infer_states(df: DataFrame, n_states: int = 3, seed: int = 0, r: str = "return", keep: Sequence[str] = (), by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, order, kept columns, posterior (array), state: full-sample fit and smoothed posteriors."""
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        values = frame[r].to_numpy(float)
        model = fit_hmm(values, n_states, seed=seed)
        posterior, _, _ = smooth(densities(values, model["means"], model["stds"]), model["start"], model["transition"])
        out = frame[[*by, order, *keep]].copy()
        out["posterior"] = list(posterior)
        out["state"] = posterior.argmax(axis=1).astype(np.int32)
        return out

    some = df.where(F.col(r).isNotNull()).select(*by, order, *keep, r)
    return some.groupBy(*by).applyInPandas(one, f"{_keys_schema(some, by, order, *keep)}, posterior array<double>, state int")


def confusion(df: DataFrame, true: str = "regime", predicted: str = "state", by=ts.KEYS) -> DataFrame:
    """keys, true, predicted, n."""
    return df.groupBy(*by, F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def detection_lag(df: DataFrame, true: str = "regime", predicted: str = "aligned", max_lag: int = MAX_LAG, by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, changes, mean_lag: rows from each change of the true state until the detector first names the new one, ``max_lag`` if it does not within that many rows."""
    w = ts.spec(by, order)
    placed = df.select(*by, order, F.col(true).alias("_t"), F.col(predicted).alias("_p"), ts.row_index(by, order).alias("_i"))
    ahead = F.collect_list("_p").over(w.rowsBetween(0, max_lag - 1))
    marked = placed.withColumns({"_w": ahead, "_before": F.lag("_t").over(w)}).where("_t <> _before")
    at = F.array_position("_w", F.col("_t")).cast("int")
    lag = F.when(at > 0, at - 1).otherwise(max_lag)
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("changes"), F.avg(lag.cast("double")).alias("mean_lag"))


def label_maps(counts: DataFrame, n_states: int, by=ts.KEYS) -> DataFrame:
    """keys, label_map: the label of each inferred state, from the counts of ``confusion``; labels outside 0 .. n_states - 1 do not count."""

    def mapping(frame: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((n_states, n_states))
        inside = frame[frame["true"].between(0, n_states - 1) & frame["predicted"].between(0, n_states - 1)]
        np.add.at(table, (inside["predicted"].astype(int), inside["true"].astype(int)), inside["n"])
        out = frame[[*by]].iloc[:1].copy()
        out["label_map"] = [list(align_states(table).values())]
        return out

    return counts.groupBy(*by).applyInPandas(mapping, f"{_keys_schema(counts, by)}, label_map array<int>")


def aligned_agreement(df: DataFrame, n_states: int, true: str = "regime", state: str = "state", by=ts.KEYS) -> DataFrame:
    """keys, agreed, accuracy: rows whose state, by its label, is the true one."""
    counts = confusion(df, true, state, by)
    met = counts.join(label_maps(counts, n_states, by), list(by))
    agreed = F.sum(F.when(F.element_at("label_map", F.col("predicted") + 1) == F.col("true"), F.col("n")).otherwise(0))
    return met.groupBy(*by).agg(agreed.alias("agreed"), (agreed / F.sum("n").cast("double")).alias("accuracy"))


def detect_regimes(df: DataFrame, n_states: int = 3, seed: int = 0, true: str = "regime", by=ts.KEYS, order: str = "date") -> dict[str, DataFrame]:
    """Frames ``states`` (state, aligned, posterior in the order of true labels), ``confusion``, ``scores`` (accuracy, mean_lag) by series."""
    inferred = infer_states(df, n_states, seed, keep=[true], by=by, order=order)

    maps = label_maps(confusion(inferred, true, "state", by), n_states, by)
    joined = inferred.join(maps, list(by))
    labels = F.sequence(F.lit(0), F.lit(n_states - 1))
    ordered = F.transform(labels, lambda t: F.element_at("posterior", F.array_position("label_map", t.cast("int")).cast("int")))
    states = joined.withColumn("aligned", F.element_at("label_map", F.col("state") + 1)).withColumn("posterior", ordered)
    accuracy = states.groupBy(*by).agg(F.avg((F.col("aligned") == F.col(true)).cast("double")).alias("accuracy"))
    lag = detection_lag(states, true, "aligned", MAX_LAG, by, order)
    return {"states": states, "confusion": confusion(states, true, "aligned", by), "scores": accuracy.join(lag, list(by), "left")}


def filter_fold(r: np.ndarray, train: int, n_states: int, seed: int) -> np.ndarray:
    """Filtered probabilities of all rows with parameters fitted on the first ``train`` rows; states by ascending mean."""
    model = fit_hmm(r[:train], n_states, seed=seed)
    return filter_states(r, model["transition"], model["means"], model["stds"])[0]


def walk_forward_posteriors(df: DataFrame, min_train: int, test: int, n_states: int = 3, seed: int = 0, r: str = "return", by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, order, fold, regime_prob_0..: for each fold a fit on the rows before it and causal probabilities of its rows."""
    names = [f"regime_prob_{k}" for k in range(n_states)]
    rows = expanding_rows(df.where(F.col(r).isNotNull()).select(*by, order, r), min_train, test, by=by, order=order)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        train = int((~frame["is_test"]).sum())
        probabilities = filter_fold(frame[r].to_numpy(float), train, n_states, seed)
        out = frame[[*by, order, "fold"]].iloc[train:].reset_index(drop=True)
        return out.assign(**{name: probabilities[train:, k] for k, name in enumerate(names)})

    schema = f"{_keys_schema(rows, by, order)}, fold int, {', '.join(f'{n} double' for n in names)}"
    return rows.groupBy(*by, "fold").applyInPandas(one, schema)


def terciles_by_value(df: DataFrame, value: str = "value", states: int = 3, by=ts.KEYS, out: str = "regime") -> DataFrame:
    """States by equal-count bins of a value."""
    return ts.quantile_bins(df, value, states, by, out)


def transition_counts(df: DataFrame, state: str = "regime", by=ts.KEYS, order: str = "date") -> DataFrame:
    """keys, from_state, to_state, n over neighbouring rows."""
    pairs = df.select(*by, F.lag(state).over(Window.partitionBy(*by).orderBy(order)).alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null")
    return pairs.groupBy(*by, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
