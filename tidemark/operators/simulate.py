"""Simulators: distributed over paths, each path with its own generator seeded by (seed, path)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import ts

# Fixed values of the market model: rows of daily transition probabilities,
# daily drift and daily volatility of the calm, trending and stressed regimes.
TRANSITION = np.array([[0.96, 0.03, 0.01], [0.05, 0.90, 0.05], [0.03, 0.07, 0.90]])
DRIFT = np.array([0.0002, 0.0008, -0.0005])
VOLATILITY = np.array([0.006, 0.012, 0.020])
AR_COEFFICIENT, START_PRICE, START_DATE = 0.12, 100.0, "2016-01-01"


def _paths(spark: SparkSession, n_paths: int, one: Callable[[np.random.Generator], dict], schema: str, seed: int | None, first: int = 0) -> DataFrame:
    """Rows of every path; ``one`` makes the columns of a path from its generator."""
    key = 0 if seed is None else seed

    def work(batches):
        for batch in batches:
            for path in batch["id"]:
                made = pd.DataFrame(one(np.random.default_rng([key, int(path)])))
                made.insert(0, "path_id", int(path))
                yield made

    parts = max(1, min(n_paths, spark.sparkContext.defaultParallelism * 4))
    return spark.range(first, first + n_paths, numPartitions=parts).mapInPandas(work, f"path_id long, {schema}")


def _driven(shocks: DataFrame, one: Callable[..., dict], names: tuple[str, ...], schema: str) -> DataFrame:
    """Rows of every path from given shocks (path_id, step from 1, the named columns) in place of drawn ones."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("step")
        made = pd.DataFrame(one(*[frame[c].to_numpy(float) for c in names]))
        made.insert(0, "path_id", frame["path_id"].iloc[0])
        return made

    return shocks.select("path_id", "step", *names).groupBy("path_id").applyInPandas(work, f"path_id long, {schema}")


def _states(rng: np.random.Generator, transition: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """A Markov chain by inverse transform of one uniform for each step."""
    steps = np.cumsum(transition, axis=1)
    draws = rng.random(n)
    out = np.empty(n, np.int32)
    state = first
    for k in range(n):
        if k:
            state = min(int(np.searchsorted(steps[state], draws[k], "right")), transition.shape[0] - 1)
        out[k] = state
    return out


def simulate_market(spark: SparkSession, n_days: int = 2500, seed: int = 7, n_series: int = 1) -> DataFrame:
    """series_id, date, price, return, regime: regime-switching returns with autocorrelated noise, on weekdays."""
    def one(rng: np.random.Generator) -> dict:
        regime = _states(rng, TRANSITION, n_days)
        noise = rng.normal(0.0, VOLATILITY[regime])
        noise[0] = 0.0
        # x_t = a x_(t-1) + e_t by its truncated kernel: powers of a beyond 24 are below the last bit.
        smooth = np.convolve(noise, AR_COEFFICIENT ** np.arange(min(24, n_days)))[:n_days]
        r = DRIFT[regime] + smooth
        dates = np.busday_offset(np.datetime64(START_DATE), np.arange(n_days), roll="forward")
        return {"date": dates.astype("datetime64[ns]"), "price": START_PRICE * np.exp(np.cumsum(r)), "return": r, "regime": regime}

    made = _paths(spark, n_series, one, "date date, price double, return double, regime int", seed)
    return made.select(F.concat(F.lit("SIM"), F.col("path_id")).alias("series_id"), "date", "price", "return", "regime")


def brownian_increments(spark: SparkSession, T: float, n_steps: int, n_paths: int = 1, seed: int | None = None) -> DataFrame:
    """path_id, step (1..n), dw."""
    def one(rng: np.random.Generator) -> dict:
        return {"step": np.arange(1, n_steps + 1), "dw": rng.normal(0.0, (T / n_steps) ** 0.5, n_steps)}

    return _paths(spark, n_paths, one, "step int, dw double", seed)


def gbm_exact(mu: float, sigma: float, x0: float, t, w):
    """Closed-form solution as an expression of time and Brownian motion."""
    return F.lit(x0) * F.exp(F.lit(mu - 0.5 * sigma**2) * ts.as_col(t) + F.lit(sigma) * ts.as_col(w))


def simulate_gbm(spark: SparkSession, mu: float, sigma: float, x0: float, T: float, n_steps: int, seed: int | None = None, scheme: str = "euler", increments: DataFrame | None = None, n_paths: int = 1) -> DataFrame:
    """path_id, step, t, x. Every step multiplies by a factor, so a path is a windowed product; ``increments``: (path_id, step from 1, dw)."""
    dt = T / n_steps
    dw = F.col("dw")
    factors = {"euler": 1.0 + mu * dt + sigma * dw, "milstein": 1.0 + mu * dt + sigma * dw + 0.5 * sigma**2 * (dw * dw - dt)}
    if scheme not in factors:
        raise ValueError(f"unknown scheme: {scheme}")
    noise = increments if increments is not None else brownian_increments(spark, T, n_steps, n_paths, seed)
    steps = noise.select("path_id", "step", factors[scheme].alias("_f"))
    starts = noise.select("path_id").distinct().select("path_id", F.lit(0).cast("int").alias("step"), F.lit(1.0).alias("_f"))
    w = Window.partitionBy("path_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.unionByName(starts).select("path_id", "step", (F.col("step") * F.lit(dt)).alias("t"), (F.lit(x0) * F.product("_f").over(w)).alias("x"))


def ou_stationary_variance(kappa: float, sigma: float) -> float:
    return sigma**2 / (2 * kappa)


def simulate_ou(spark: SparkSession, kappa: float, theta: float, sigma: float, x0: float, T: float, n_steps: int, seed: int | None = None, scheme: str = "exact", n_paths: int = 1, shocks: DataFrame | None = None) -> DataFrame:
    """path_id, step, t, x, by the exact transition law or by Euler steps: both are linear recursions x' = c + a x + b z. ``shocks``: (path_id, step from 1, z)."""
    dt = T / n_steps
    if scheme == "exact":
        a = float(np.exp(-kappa * dt))
        b = float(np.sqrt(sigma**2 * (1 - a * a) / (2 * kappa)))
    elif scheme == "euler":
        a, b = 1 - kappa * dt, sigma * dt**0.5
    else:
        raise ValueError(f"unknown scheme: {scheme}")

    def path(z: np.ndarray) -> dict:
        x = np.empty(n_steps + 1)
        x[0] = x0 - theta
        for k in range(n_steps):
            x[k + 1] = a * x[k] + b * z[k]
        return {"step": np.arange(n_steps + 1), "t": np.linspace(0.0, T, n_steps + 1), "x": x + theta}

    schema = "step int, t double, x double"
    if shocks is not None:
        return _driven(shocks, path, ("z",), schema)
    return _paths(spark, n_paths, lambda rng: path(rng.standard_normal(n_steps)), schema, seed)


def estimate_ou(df: DataFrame, x: str, dt: float, by=("path_id",), order: str = "step") -> DataFrame:
    """keys, kappa, theta, sigma by maximum likelihood of the autoregression, from sums of one pass.

    theta takes the unclipped intercept over the clipped slope.
    """
    pairs = df.select(*by, F.col(x).alias("_a"), F.lead(x).over(ts.spec(by, order)).alias("_b")).where("_b is not null")
    s = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_a").alias("ma"), F.avg("_b").alias("mb"), F.var_pop("_a").alias("va"), F.var_pop("_b").alias("vb"), F.covar_pop("_a", "_b").alias("c"))
    slope = ts.ratio("c", "va")
    s = s.withColumn("slope", slope).withColumn("b", F.greatest(F.lit(1e-8), F.least(F.lit(1 - 1e-8), slope)))
    residual = ts.ratio((F.col("vb") - F.col("slope") * F.col("c")) * F.col("n"), F.col("n") - 2)
    kappa = -F.log("b") / dt
    return s.select(
        *by, kappa.alias("kappa"), ((F.col("mb") - F.col("slope") * F.col("ma")) / (1 - F.col("b"))).alias("theta"),
        F.sqrt(2 * kappa * F.greatest(residual, F.lit(0.0)) / (1 - F.col("b") * F.col("b"))).alias("sigma"),
    )


def simulate_heston(spark: SparkSession, mu: float, kappa: float, theta: float, xi: float, rho: float, s0: float, v0: float, T: float, n_steps: int, seed: int | None = None, n_paths: int = 1, shocks: DataFrame | None = None) -> DataFrame:
    """path_id, step, t, price, variance: full-truncation Euler; the reported variance is never negative. ``shocks``: (path_id, step from 1, z1, z2)."""
    dt = T / n_steps

    def path(z1: np.ndarray, z2: np.ndarray) -> dict:
        dv, ds = z1 * dt**0.5, (rho * z1 + (1 - rho * rho) ** 0.5 * z2) * dt**0.5
        v = np.empty(n_steps + 1)
        v[0] = v0
        for k in range(n_steps):
            up = max(v[k], 0.0)
            v[k + 1] = v[k] + kappa * (theta - up) * dt + xi * up**0.5 * dv[k]
        up = np.maximum(v, 0.0)
        log_s = np.log(s0) + np.concatenate(([0.0], np.cumsum((mu - 0.5 * up[:-1]) * dt + np.sqrt(up[:-1]) * ds)))
        return {"step": np.arange(n_steps + 1), "t": np.linspace(0.0, T, n_steps + 1), "price": np.exp(log_s), "variance": up}

    schema = "step int, t double, price double, variance double"
    if shocks is not None:
        return _driven(shocks, path, ("z1", "z2"), schema)
    return _paths(spark, n_paths, lambda rng: path(*rng.standard_normal((2, n_steps))), schema, seed)


def feller_condition(kappa, theta, xi):
    """Whether the variance stays positive: numbers or columns."""
    return 2 * kappa * theta > xi * xi


def simulate_merton(spark: SparkSession, mu: float, sigma: float, jump_intensity: float, jump_mean: float, jump_std: float, s0: float, T: float, n_steps: int, seed: int | None = None, n_paths: int = 1, shocks: DataFrame | None = None) -> DataFrame:
    """path_id, step, t, price, jumps: jump diffusion whose drift makes up for the jumps' mean. ``shocks``: (path_id, step from 1, jumps, size, z), size and z standard normal."""
    dt = T / n_steps
    drift = (mu - 0.5 * sigma**2 - jump_intensity * (np.exp(jump_mean + 0.5 * jump_std**2) - 1)) * dt

    def path(jumps: np.ndarray, size: np.ndarray, z: np.ndarray) -> dict:
        jumps = jumps.astype(np.int64)
        # A sum of n normal jumps is normal with n times mean and variance.
        sizes = jumps * jump_mean + np.sqrt(jumps) * jump_std * size
        steps = drift + sigma * dt**0.5 * z + sizes
        return {"step": np.arange(n_steps + 1), "t": np.linspace(0.0, T, n_steps + 1), "price": s0 * np.exp(np.concatenate(([0.0], np.cumsum(steps)))), "jumps": np.concatenate(([0], jumps))}

    schema = "step int, t double, price double, jumps long"
    if shocks is not None:
        return _driven(shocks, path, ("jumps", "size", "z"), schema)
    return _paths(spark, n_paths, lambda rng: path(rng.poisson(jump_intensity * dt, n_steps), *rng.standard_normal((2, n_steps))), schema, seed)


def generator_of(daily_transition: np.ndarray, dt_day: float = 1.0) -> np.ndarray:
    """First-order generator of a continuous-time chain from daily transition probabilities."""
    p = np.asarray(daily_transition, float)
    return (p - np.eye(p.shape[0])) / dt_day


def simulate_ctmc(spark: SparkSession, generator: np.ndarray, T: float, x0: int, seed: int | None = None, n_paths: int = 1) -> DataFrame:
    """path_id, k, jump_time, state: exact paths; an absorbing state ends its path."""
    q = np.asarray(generator, float)

    def one(rng: np.random.Generator) -> dict:
        times, states, t, state = [0.0], [x0], 0.0, x0
        while (rate := -q[state, state]) > 0:
            t += rng.exponential(1 / rate)
            if t >= T:
                break
            moves = np.where(np.arange(q.shape[0]) == state, 0.0, q[state])
            state = int(rng.choice(q.shape[0], p=moves / moves.sum()))
            times.append(t)
            states.append(state)
        return {"k": np.arange(len(times)), "jump_time": times, "state": states}

    return _paths(spark, n_paths, one, "k int, jump_time double, state int", seed)


def occupancy(paths: DataFrame, T: float | None = None) -> DataFrame:
    """path_id, state, time: how long each state is held, the last until T, or not at all where that is None."""
    w = Window.partitionBy("path_id").orderBy("k")
    end = F.col("jump_time") if T is None else F.lit(float(T))
    held = F.coalesce(F.lead("jump_time").over(w), end) - F.col("jump_time")
    return paths.select("path_id", "state", held.alias("_h")).groupBy("path_id", "state").agg(F.sum("_h").alias("time"))


def simulate_factor_returns(spark: SparkSession, n_assets: int, n_days: int, factor_vols=(0.015, 0.008), idio_vol: float = 0.01, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((t, x array<double>), loadings, true covariance): days are simulated in parallel, loadings are fixed by the seed."""
    rng = np.random.default_rng([seed, 1 << 40])
    k = len(factor_vols)
    loadings = rng.uniform(0.3, 1.2, (n_assets, k))
    loadings[:, 0] = rng.uniform(0.6, 1.4, n_assets)
    vols = np.array(factor_vols)
    truth = (loadings * vols**2) @ loadings.T + idio_vol**2 * np.eye(n_assets)

    def work(batches):
        for batch in batches:
            rows = []
            for t in batch["id"]:
                own = np.random.default_rng([seed, int(t)])
                rows.append(loadings @ (vols * own.standard_normal(k)) + idio_vol * own.standard_normal(n_assets))
            yield pd.DataFrame({"t": batch["id"], "x": rows})

    days = spark.range(n_days).mapInPandas(work, "t long, x array<double>")
    return days, loadings, truth
