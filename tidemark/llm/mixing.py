"""Mixing sources to target weights by pivotal dependent rounding.

1. A document's size is its number of words (runs of characters other than
   U+0020 and U+0009 to U+000D), counted natively over the whole text.
2. Sources in code point order weigh ``weights``, repeating, and share the total
   of all sizes. A target stops at ``most`` times its source's size, and the excess
   is shared again by weight: the level that settles is found by aggregates over
   the table of sources, two numbers a round.
3. Every document of a source is wanted target / size times: so many whole copies,
   and a fraction that is rounded dependently. Two fractional documents at a time,
   one gives and one takes the same number of words, in a random direction whose
   odds keep both expectations, until one of them is whole. A source's expected
   words stay what they are in every step.
4. Reduction tree: a source's fractional documents, in the order of a hash, are
   dealt to blocks of ``block_rows``; each block leaves one fractional document,
   and these meet in blocks again. The last block of a source also holds
   documents kept back from the start, the smaller last, so that what is left in
   the end tends to be small. That one document goes to the nearer whole number,
   so a source is off its target by half of it at most. Where that is more than
   ENOUGH of the target (sources of few documents), the last block is drawn again,
   TRIES times at most, and the draw that ends nearest is kept: expectations are
   exact in a single draw, and nearly so among those kept.

Draws are seeded by source, level and block, so reruns agree. A task takes
``2 * block_rows`` rows of four numbers at most, whatever a source's share of the rows.

Defined cases: a null or empty text, and one of white space, has size 0 and is
taken 0 times; null sources are a source of their own, after all others; a
source without words has target 0; null ids and repeated rows are documents each
(those equal in id and size are interchangeable); an empty table gives an empty
result; other columns are not read, and pass through ``repeat`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.operators import blocks

WEIGHTS, MOST, BLOCK_ROWS, SEED = (1.0, 2.0, 3.0), 3, 4096, 12
WORD = r"[^\x20\x09-\x0D]+"
#: Draws of a source's last block, and the share of its target that it may be off without another one.
TRIES, ENOUGH = 64, 1e-3
#: A fraction nearer than this to a whole number is whole.
NEAR = 1e-12
_SOURCE = ["_null", "_source"]
_KEPT = "doc_id long, size long, source_size long, target double, whole long, _null boolean, _source string, block long, share double"


def sized(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size and the source, null or not, of every document; written, so that the texts are read once."""
    name = F.col(common.quoted(source)).cast("string")
    words = F.regexp_count(F.col(common.quoted(text)), F.lit(WORD))
    made = docs.select(F.col(common.quoted(doc_id)).cast("long").alias("doc_id"), F.coalesce(words, F.lit(0)).cast("long").alias("size"), name.isNull().alias("_null"), F.coalesce(name, F.lit("")).alias("_source"))
    return common.written(made, "document-sizes")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each source: source_size, weight, target. Written."""
    totals = sizes.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    turn = (F.col(blocks.POS) % len(weights)).cast("int")
    sources = common.written(blocks.positioned(totals, [], _SOURCE).withColumn("weight", F.array(*map(F.lit, weights))[turn]).drop(blocks.POS), "sources")
    cap = F.col("source_size") * most
    first = sources.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level, words = (first["words"] / first["weight"] if first["weight"] else 0.0), first["words"] or 0
    while level:  # sources that the level would put above their cap stay at it, and the rest share what is left
        over = cap < F.lit(level) * F.col("weight")
        got = sources.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        again = (words - (got["capped"] or 0)) / got["weight"] if got["weight"] else level
        if again <= level:
            break
        level = again
    return common.written(sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight"))), "source-targets")


def pivot(mass: np.ndarray, share: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Shares, all 0 or 1 but one at most. In each step two documents exchange the same number of words until one of them is whole."""
    out = share.copy()
    held = -1
    for k in range(out.size):
        if not 0 < out[k] < 1:
            continue
        if held < 0:
            held = k
            continue
        a, b, x, y = mass[held], mass[k], out[held], out[k]
        rise, fall = min((1 - x) * a, y * b), min(x * a, (1 - y) * b)  # words to the held one, and from it
        if draws[k] * (rise + fall) < fall:
            x, y = (1.0, y - rise / b) if rise == (1 - x) * a else (x + rise / a, 0.0)
        else:
            x, y = (0.0, y + fall / b) if fall == x * a else (x - fall / a, 1.0)
        x, y = (float(round(v)) if abs(v - round(v)) < NEAR else v for v in (x, y))
        out[held], out[k] = x, y
        held = held if 0 < x < 1 else k if 0 < y < 1 else -1
    return out


def _settled(rows: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """Each block's documents with their shares after rounding: 0 or 1, but one for each block; none in the last level. Written."""

    def one(part: pa.Table) -> pa.Table:
        mass, share = (part.column(c).to_numpy().astype(float) for c in ("size", "share"))
        key = f"{seed}|{level}|{part.column('_null')[0]}|{part.column('_source')[0]}|{part.column('block')[0]}"
        draws = np.random.default_rng(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big"))
        ids = part.column("doc_id")
        order = np.lexsort((share, ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), -mass))
        mass, made = mass[order], np.empty_like(share)
        best, off = None, np.inf
        for _ in range(TRIES if last else 1):
            found = pivot(mass, share[order], draws.random(mass.size))
            found = np.rint(found) if last else found
            error = abs(float(mass @ (found - share[order])))
            if error < off:
                best, off = found, error
            if off <= ENOUGH * part.column("target")[0].as_py():
                break
        made[order] = best
        return part.set_column(part.schema.get_field_index("share"), "share", pa.array(made))

    return common.written(rows.groupBy(*_SOURCE, "block").applyInArrow(one, _KEPT), "settled")


def copies(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = WEIGHTS, most: int = MOST,
    block_rows: int = BLOCK_ROWS, seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target (its source's), copies, taken (words: size times copies) of every document."""
    sizes = sized(docs, text, source, doc_id)
    sources = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.when(F.col("size") > 0, F.floor(rate + NEAR)).otherwise(F.lit(0))
    share = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - whole)).otherwise(F.lit(0.0))
    kept = ["doc_id", "size", "source_size", "target", "whole", *_SOURCE]
    rows = sizes.join(sources.drop("weight"), _SOURCE).withColumn("whole", whole).withColumn("share", F.when(share < NEAR, F.lit(0.0)).otherwise(share))
    plain = rows.where("share = 0").select(*kept, "share")
    open_rows = rows.where("share > 0").withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "size"))
    placed = blocks.positioned(open_rows, _SOURCE, ["_order"], ["doc_id", "size"]).withColumn("block", F.floor(F.col(blocks.POS) / block_rows))
    placed = common.written(placed.select(*kept, "block", "share"), "fractions")
    most_blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    # The first block of each source waits for the last level.
    waiting, level, done = placed.where("block > 0"), 0, [plain]
    while most_blocks > 1:
        found = _settled(waiting, level, seed, last=False)
        done.append(found.where("share in (0, 1)").select(*kept, "share"))
        left = found.where("share not in (0, 1)")
        if most_blocks <= block_rows:
            waiting = left
            break
        waiting, most_blocks, level = left.withColumn("block", F.floor(F.col("block") / block_rows)), -(-most_blocks // block_rows), level + 1
    root = placed.where("block = 0").unionByName(waiting).withColumn("block", F.lit(0).cast("long"))
    done.append(_settled(root, -1, seed, last=True).select(*kept, "share"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    times = F.col("whole") + F.col("share").cast("long")
    return out.select("doc_id", "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"))


def repeat(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with each row as many times as the plan of ``copies`` takes it; same columns. Ids must be unique and not null; a repeated one raises an error."""
    rows = common.packed(docs, id=F.col(common.quoted(doc_id)).cast("long"))
    once = plan.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_n"))
    times = F.when(F.col("_n") == 1, F.col("_copies")).otherwise(F.raise_error(F.lit("an id stands in several rows")).cast("long"))
    wanted = rows.join(once.select("_id", times.alias("_copies")), F.col("id") == F.col("_id"))
    return wanted.where("_copies > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")
