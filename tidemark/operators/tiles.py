"""Covariances and leading eigenpairs of wide panels, never an N x N matrix in one task or on the driver.

- Cross products: the columns are cut into blocks of ``width``. A task takes one pair
  of column blocks of one chunk of rows and returns that tile's partial sums, so
  it holds 2 * width * chunk_rows numbers. Tiles stay rows of a frame.
- Spectrum: the leading eigenpairs by a block Krylov method with a random start.
  Each step is one pass over the rows, which multiplies the covariance (or
  correlation) by a block of N x b numbers without making it; the basis, N x
  (steps * b) numbers, is kept orthonormal on the driver. It ends when the wanted
  values settle, or when the basis spans all columns, where they are exact.

Defined cases: rows with a missing value are left out of arrays; a panel must have
every asset at every t (an error otherwise); a frame without rows is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ts
from tidemark.operators import blocks
from tidemark.sources import store

WIDTH, CHUNK_ROWS = 256, 8192


# --- tiles ------------------------------------------------------------------


def array_tiles(vectors: DataFrame, x: str = "x", width: int = WIDTH) -> tuple[DataFrame, int, int]:
    """(tiles, rows, columns) of an array column. Tiles: t, block, x (the block's part of the row, less the columns' means)."""
    whole = vectors.where(F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())).select(F.monotonically_increasing_id().alias("t"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    whole = store.written(whole, "vectors")  # a row keeps its number, which its parts meet by
    facts = whole.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if not facts["n"]:
        raise ValueError("a covariance needs observations")
    if facts["low"] != facts["high"]:
        raise ValueError("rows have different numbers of columns")
    n_blocks = -(-facts["high"] // width)
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda k: F.struct(k.alias("block"), F.slice("x", k * width + 1, F.lit(width)).alias("x")))
    parts = whole.select("t", F.explode(cut).alias("_p")).select("t", "_p.block", "_p.x")
    means = parts.select("block", F.posexplode("x").alias("i", "v")).groupBy("block", "i").agg(F.avg("v").alias("m")).groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return parts.join(means, "block").select("t", "block", F.zip_with("x", "m", lambda a, b: a - b).alias("x")), facts["n"], facts["high"]


def panel_tiles(panel: DataFrame, t: str = "t", asset: str = "asset", r: str = "r", width: int = WIDTH) -> tuple[DataFrame, DataFrame, int, int]:
    """(tiles, assets, rows, columns) of a long panel. assets: asset, i (its column by ascending name), m (its mean)."""
    means = panel.groupBy(F.col(asset).alias("asset")).agg(F.avg(r).alias("m"), F.count(r).alias("n"))
    assets = blocks.positioned(means, [], ["asset"]).withColumnRenamed(blocks.POS, "i")
    facts = assets.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("assets")).first()
    if not facts["high"]:
        raise ValueError("a covariance needs observations")
    if facts["low"] != facts["high"]:
        raise ValueError("every t must have all assets")
    cells = panel.select(F.col(t).alias("t"), F.col(asset).alias("asset"), F.col(r).alias("r")).join(assets, "asset")
    cells = cells.select("t", F.floor(F.col("i") / width).cast("int").alias("block"), F.struct("i", (F.col("r") - F.col("m")).alias("d")).alias("_c"))
    return cells.groupBy("t", "block").agg(F.transform(F.sort_array(F.collect_list("_c")), lambda c: c["d"]).alias("x")), assets.drop("n"), facts["high"], facts["assets"]


def cross_tiles(tiles: DataFrame, rows: int, columns: int, width: int = WIDTH, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(i, j, s): sums of products of all pairs of columns."""
    chunks = max(1, -(-rows // chunk_rows))
    other = F.sequence(F.lit(0), F.lit(-(-columns // width) - 1))
    pairs = F.transform(other, lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")))
    dealt = tiles.select("t", "block", "x", F.pmod(F.xxhash64("t"), F.lit(chunks)).alias("chunk"), F.explode(pairs).alias("_p")).select("t", "block", "x", "chunk", "_p.a", "_p.b")

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
        frame = frame.sort_values("t")
        left, right = (np.stack(frame.loc[frame["block"] == k, "x"].to_list()) for k in (a, b))
        made = left.T @ right
        return pd.DataFrame({"i": a * width + np.arange(len(made)), "first": b * width, "s": list(made)})

    parts = dealt.groupBy("a", "b", "chunk").applyInPandas(product, "i long, first long, s array<double>")
    cells = parts.select("i", "first", F.posexplode("s").alias("k", "s")).select("i", (F.col("first") + F.col("k")).alias("j"), "s")
    sums = cells.groupBy("i", "j").agg(F.sum("s").alias("s"))
    # Tiles on and above the diagonal were made; those off it stand for their mirror images too.
    mirrored = sums.where(F.floor(F.col("i") / width) != F.floor(F.col("j") / width)).select(F.col("j").alias("i"), F.col("i").alias("j"), "s")
    return sums.unionByName(mirrored)


def array_covariance(vectors: DataFrame, x: str = "x", ddof: int = 1, width: int = WIDTH, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(i, j, cov) of an array column, by positions."""
    tiles, n, columns = array_tiles(vectors, x, width)
    return cross_tiles(tiles, n, columns, width, chunk_rows).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.col("s") / float(n - ddof)).alias("cov"))


def panel_covariance(panel: DataFrame, t: str = "t", asset: str = "asset", r: str = "r", ddof: int = 1, width: int = WIDTH, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(i, j, cov) of a long panel, by assets."""
    tiles, assets, n, columns = panel_tiles(panel, t, asset, r, width)
    made = cross_tiles(tiles, n, columns, width, chunk_rows)
    names = [assets.select(F.col("i").alias(k), F.col("asset").alias(f"_{k}")) for k in ("i", "j")]
    named = made.join(names[0], "i").join(names[1], "j")
    return named.select(F.col("_i").alias("i"), F.col("_j").alias("j"), (F.col("s") / float(n - ddof)).alias("cov"))


def correlation(cov: DataFrame) -> DataFrame:
    """(i, j, rho) of a covariance frame."""
    own = cov.where("i = j").select("i", F.sqrt("cov").alias("d"))
    sides = [own.select(F.col("i").alias(k), F.col("d").alias(f"_{k}")) for k in ("i", "j")]
    return cov.join(sides[0], "i").join(sides[1], "j").select("i", "j", (F.col("cov") / F.col("_i") / F.col("_j")).alias("rho"))


def ledoit_wolf(panel: DataFrame, t: str = "t", asset: str = "asset", r: str = "r", width: int = WIDTH, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(shrunk covariance i, j, cov by column numbers; one row n_obs, delta) towards the scaled identity, from aggregates of the tiles."""
    tiles, _, n, columns = panel_tiles(panel, t, asset, r, width)
    s = cross_tiles(tiles, n, columns, width, chunk_rows).select("i", "j", (F.col("s") / float(n)).alias("s"))
    diagonal = F.col("i") == F.col("j")
    facts = s.agg(F.sum("s").alias("_all"), F.sum(F.when(diagonal, F.col("s"))).alias("_trace"), F.count_if(diagonal).alias("_n"), F.sum(F.col("s") * F.col("s")).alias("_f"))
    norms = tiles.groupBy("t").agg(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("q")).agg(F.avg(F.col("q") * F.col("q")).alias("_m4"))
    mu = F.col("_trace") / F.col("_n")
    # |S - mu I|^2 = |S|^2 - N mu^2, as mu is the mean of the diagonal.
    gamma = F.col("_f") - F.col("_n") * mu * mu
    raw = (F.col("_m4") - F.col("_f")) / ts.null_if_zero(gamma) / float(n)
    # Both are one row.
    law = facts.join(norms, F.lit(True)).select(F.lit(n).cast("long").alias("n_obs"), F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), F.lit(0.0)).alias("delta"), mu.alias("_mu"))
    shrunk = s.join(F.broadcast(law), F.lit(True)).select("i", "j", (F.col("delta") * F.when(diagonal, F.col("_mu")).otherwise(0.0) + (1 - F.col("delta")) * F.col("s")).alias("cov"))
    return shrunk, law.drop("_mu")


# --- leading eigenpairs -----------------------------------------------------


def _column_facts(vectors: DataFrame, x: Column) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population variances) of an array column: N numbers each."""
    cells = vectors.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).collect()
    if not cells:
        raise ValueError("a spectrum needs observations")
    cells = sorted(cells, key=lambda r: r["i"])
    if len({r["n"] for r in cells}) != 1:
        raise ValueError("rows have different numbers of columns")
    return cells[0]["n"], np.array([r["m"] for r in cells]), np.array([r["s"] for r in cells])


def leading_eigenpairs(
    vectors: DataFrame, k: int = 8, x: str = "x", of_correlation: bool = False, ddof: int = 1, extra: int = 8, tol: float = 1e-10, most_steps: int = 60, seed: int = 0,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(values descending, vectors as columns, trace) of the covariance, or correlation, of an array column; rows with a null are left out."""
    spark = vectors.sparkSession
    some = vectors.where(F.col(x).isNotNull() & ~F.exists(x, lambda v: v.isNull())).select(F.transform(x, lambda v: v.cast("double")).alias("x"))
    n, mean, variance = _column_facts(some, F.col("x"))
    size = mean.size
    scale = np.sqrt(n / (n - ddof)) * np.ones(size) if not of_correlation else 1 / np.sqrt(np.where(variance > 0, variance, np.inf))
    width = min(size, k + extra)

    def times(block: np.ndarray) -> np.ndarray:
        """The matrix times a block, by one pass; tasks return N x b sums."""
        shared = spark.sparkContext.broadcast((mean, scale, block))

        def work(batches):
            m, c, q = shared.value
            total = np.zeros_like(q)
            for batch in batches:
                if len(batch):
                    d = (np.stack(batch["x"].to_list()) - m) * c
                    total += d.T @ (d @ q)
            yield pd.DataFrame({"i": np.arange(total.shape[0]), "s": list(total)})

        sums = some.mapInPandas(work, "i long, s array<double>").select("i", F.posexplode("s").alias("c", "s")).groupBy("i", "c").agg(F.sum("s").alias("s")).toPandas()
        shared.destroy()
        out = np.zeros(block.shape)
        out[sums["i"], sums["c"]] = sums["s"] / n
        return out

    block, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))
    basis, images, last = block, times(block), np.full(min(k, size), np.inf)
    for _ in range(most_steps):
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        if np.abs(values - last).max() <= tol * max(values.max(), 1e-300) or basis.shape[1] >= size:
            break
        last = values
        # The newest images, less what the basis has of them (twice, against rounding), are the next block.
        fresh = images[:, -block.shape[1] :]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        left, weight, _ = np.linalg.svd(fresh, full_matrices=False)
        left = left[:, weight > 1e-13 * max(1e-300, np.abs(values).max())][:, : size - basis.shape[1]]
        if not left.shape[1]:
            break
        block = left
        basis, images = np.hstack((basis, block)), np.hstack((images, times(block)))
    return values, basis @ inner, float((scale**2 * variance).sum())
