"""Toxicity by maximum-scoring segment search over token log-odds.

Fit (bounded, documented): the ``fit_rows`` labelled texts of each class with
the smallest hashes, from rows that are not held out, as long as those of a class
have ``fit_bytes`` together (no text is cut; one of more by itself is passed over).
- Tokens get log-odds of the toxic against the clean class, counted in
  documents, with informative Dirichlet priors: a word's prior is centred on the
  other words of its stem (its first bytes), and a stem's on the whole class, so
  rare words lean on what is known of their stem. A drift is taken off, which
  makes the mean over clean text negative.
- The scores' null distribution on clean text gives the extreme-value
  parameters: lambda solves sum p(s) exp(lambda s) = 1 (Karlin and Altschul),
  and K is fitted to the best segments of clean texts of all lengths.
- A logistic curve of the calibrated evidence turns it into a probability of
  the label. Both calibrations score each half of the sample by the words of
  the other half.

Scoring, for every whole text: all maximal scoring segments are found by the
linear-time scan of Ruzzo and Tompa; their scores are calibrated to
normalised scores lambda * S - ln(K n); the significant ones are passages,
and the document's evidence is -ln of a p-value: the least over r of the tail of
the sum of its r best normalised scores, times 2^r for the choice of r. Under the
extreme-value law exp(-score) of the best segments are the first arrivals of a
Poisson process of rate 1, which gives that tail as an integral for every sum,
negative ones too (``sum_tail``). So evidence never falls when a segment rises.

Fixed bounds: a token speaks against toxicity with log-odds of LEAST_ODDS at
least, and the histogram of scores that lambda is solved from ends at -16 and 16.

Defined cases: null and empty texts, and texts without words, have no segment
and the score of no evidence; ties between segments go to the earlier one;
repeated rows get equal scores; of several labels of an id the highest counts;
ties of sample hashes go to the smaller id; without a training row of each class
in both halves of the sample every score is 0; an empty table gives an empty
result; other columns pass through, but for those named as the made ones.
"""

from __future__ import annotations

import math
import pickle
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import common, words

FIT_ROWS, FIT_BYTES, STEM_BYTES, PRIOR_WORD, PRIOR_STEM, DRIFT, LEAST_COUNT, ALPHA = 4000, 32 << 20, 6, 4.0, 4.0, 1.0, 2, 0.01
#: Standard deviations taken off positive log-odds: chance finds in rare words then count for little.
CAUTION = 1.0
LEAST_ODDS = -2.0
THRESHOLD = 0.3
#: Sums of so many best segments have their tail from the integral, longer ones from a bound that is never below it.
EXACT_SUMS, TAIL_STEPS = 32, 600
THETAS = np.linspace(0.02, 0.98, 33)


# --- log-odds ---------------------------------------------------------------


def tokens_of(texts: list[str | None]):
    """Yields (word hashes, stem hashes, counts of words by text, starts, ends) for runs of texts; starts and ends in bytes of the lower-cased text."""
    for buffer, ends in words.pieces([words.encode(t) for t in texts]):
        s, e = words.spans(buffer)
        cut = np.minimum(e, s + STEM_BYTES)
        stems = words.span_hashes(buffer, s, cut) ^ np.uint64(0x5DEECE66D)
        first = np.concatenate(([0], ends))
        yield words.span_hashes(buffer, s, e), stems, np.diff(np.searchsorted(s, first)), s, e, first


def log_odds(toxic: np.ndarray, clean: np.ndarray, around: np.ndarray, rate: float, prior: float) -> np.ndarray:
    """Log-odds of keys met in ``toxic`` and ``clean`` documents, with a Dirichlet prior of ``prior`` documents of which the share ``around`` is toxic.

    ``rate``: toxic share of all documents, where the log-odds are 0. CAUTION
    standard deviations are taken off positive values.
    """
    a, b = toxic + prior * around, clean + prior * (1 - around)
    odds = np.log(a / rate) - np.log(b / (1 - rate))
    return np.where(odds > 0, np.maximum(0, odds - CAUTION * np.sqrt(1 / a + 1 / b)), np.maximum(odds, LEAST_ODDS))


def lexicon(words_in: tuple, stems_in: tuple, docs_toxic: float, docs_clean: float) -> dict:
    """Scores of words and stems: ``words_in`` (keys, stems, toxic, clean), ``stems_in`` (keys, toxic, clean), counts in documents.

    A stem's prior is centred on the whole class; a word's on what the other words of its stem show.
    """
    rate = docs_toxic / (docs_toxic + docs_clean)
    key, stem, toxic, clean = words_in
    stem_key, stem_toxic, stem_clean = stems_in
    order = np.argsort(stem_key)
    stem_key, stem_toxic, stem_clean = stem_key[order], stem_toxic[order], stem_clean[order]
    at = np.searchsorted(stem_key, stem)
    others = np.maximum(0, stem_toxic[at] - toxic), np.maximum(0, stem_clean[at] - clean)
    around = (others[0] + PRIOR_STEM * rate) / (others[0] + others[1] + PRIOR_STEM)
    first = np.argsort(key)
    return {
        "words": key[first], "word_scores": log_odds(toxic, clean, around, rate, PRIOR_WORD)[first],
        "stems": stem_key, "stem_scores": log_odds(stem_toxic, stem_clean, np.full(stem_key.size, rate), rate, PRIOR_STEM),
    }


# --- segments ---------------------------------------------------------------


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, by the linear-time scan.

    Runs of scores of one sign are joined first: a maximal segment holds whole runs of positive scores.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.concatenate(([True], positive[1:] != positive[:-1])))
    sums = np.add.reduceat(scores, edges)
    bounds = np.append(edges, scores.size)
    # Each candidate: start, end, total before it, total to its end, the nearest earlier candidate with a smaller total before it.
    lefts: list[float] = []
    rights: list[float] = []
    spans: list[tuple[int, int]] = []
    smaller: list[int] = []
    total = 0.0
    for k in range(edges.size):
        value = float(sums[k])
        if value <= 0:
            total += value
            continue
        left, start = total, int(bounds[k])
        total += value
        right, end = total, int(bounds[k + 1])
        while True:
            j = len(lefts) - 1
            while j >= 0 and lefts[j] >= left:
                j = smaller[j]
            if j < 0 or rights[j] >= right:
                lefts.append(left)
                rights.append(right)
                spans.append((start, end))
                smaller.append(j)
                break
            left, start = lefts[j], spans[j][0]
            del lefts[j:], rights[j:], spans[j:], smaller[j:]
    return [(s, e, r - left) for (s, e), left, r in zip(spans, lefts, rights, strict=True)]


def solve_lambda(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(lambda * value) = 1; needs a negative mean and a positive value."""
    low, high = 0.0, 1.0
    while float(share @ np.exp(np.minimum(high * values, 700))) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        if float(share @ np.exp(np.minimum(mid * values, 700))) < 1:
            low = mid
        else:
            high = mid
    return high


@lru_cache(maxsize=1)
def _tails() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sum, step, values): -ln P(T >= t) of the sums T of the 1 to EXACT_SUMS best normalised scores, at TAIL_STEPS + 1 sums each.

    With the arrivals G_1 < ... < G_r of a Poisson process, T = -ln(G_1 ... G_r); given G_r the others are uniform
    below it, so T = E - r ln G_r with a Gamma(r - 1) variable E, and P(T >= t) is
    P(G_r <= exp(-t/r)) + exp(-t) / r! * integral over x > 0 of sum_{k < r-1} x^k / k! * exp(-exp((x - t) / r)).
    """
    first, step, values = np.empty(EXACT_SUMS), np.empty(EXACT_SUMS), np.empty((EXACT_SUMS, TAIL_STEPS + 1))
    k = np.arange(1, 400)
    for r in range(1, EXACT_SUMS + 1):
        low, high = -r * math.log(r + 6 * math.sqrt(r) + 6), 60.0 + 12 * r  # from a probability of nearly 1 to where the slope is settled
        t = np.linspace(low, high, TAIL_STEPS + 1)
        log_rate = -t / r
        terms = log_rate[:, None] * (r + k - 1) - np.cumsum(np.log(np.arange(1, r + 400)))[r - 1 + k - 1]
        near = _log_sum(terms) - np.exp(log_rate)  # ln P(Poisson(exp(-t/r)) >= r)
        if r == 1:
            total = near
        else:
            x = np.linspace(0, 1, 1201) * (high + r * math.log(60.0))
            polynomial = _log_sum(np.arange(r - 1) * np.log(np.maximum(x, 1e-300))[:, None] - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, r - 1))))))
            inside = polynomial - np.exp(np.minimum((x - t[:, None]) / r, 600))
            weight = np.log(np.full(x.size, x[1]) * np.where((np.arange(x.size) == 0) | (np.arange(x.size) == x.size - 1), 0.5, 1.0))
            total = np.logaddexp(near, _log_sum(inside + weight) - t - math.lgamma(r + 1))
        first[r - 1], step[r - 1] = low, t[1] - t[0]
        values[r - 1] = np.maximum.accumulate(-np.minimum(total, 0.0))
    return first, step, values


def _log_sum(logs: np.ndarray) -> np.ndarray:
    """ln of the sums of the exponentials along the last axis."""
    top = logs.max(axis=-1, keepdims=True)
    return top[..., 0] + np.log(np.exp(logs - top).sum(axis=-1))


def sum_tail(totals: np.ndarray) -> np.ndarray:
    """-ln P(T_r >= totals[r - 1]) for r = 1, 2, ...: T_r is the sum of the r best normalised scores under the null law. Rises with the total.

    Beyond EXACT_SUMS it is the exponential (Chernoff) bound, which is at most the true value.
    """
    first, step, values = _tails()
    some = totals[:EXACT_SUMS]
    row = np.arange(some.size)
    place = np.maximum(0.0, (some - first[row]) / step[row])
    at = np.minimum(place.astype(np.int64), TAIL_STEPS - 1)  # beyond the last step the last slope goes on
    exact = values[row, at] + (place - at) * (values[row, at + 1] - values[row, at])
    if totals.size <= EXACT_SUMS:
        return exact
    rest = totals[EXACT_SUMS:]
    bound = (THETAS[:, None] * rest + _log_moments(1 << (rest.size - 1).bit_length())[:, : rest.size]).max(axis=0)
    return np.concatenate((exact, np.maximum(bound, 0.0)))


@lru_cache(maxsize=4)
def _log_moments(size: int) -> np.ndarray:
    """-ln E exp(theta T_r) for each of THETAS and the ``size`` sums after the exact ones: (r - 1) ln(1 - theta) - ln Gamma(r (1 - theta)) + ln Gamma(r)."""
    r = EXACT_SUMS + 1.0 + np.arange(size)
    return (r - 1) * np.log1p(-THETAS[:, None]) - _log_gammas(r * (1 - THETAS[:, None])) + _log_gammas(r)


def _log_gammas(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers, by the series at x + 8."""
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    inverse = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - inverse * (1 / 360 - inverse / 1260)) / y - low


def evidence(segments: list[tuple[int, int, float]], n: int, lam: float, log_k: float) -> float:
    """-ln p of a document of n words: the best over r of the tail of the sum of its r best normalised scores, less r ln 2 for the choice of r; 0 at least."""
    if not segments or n <= 0:
        return 0.0
    normal = np.sort(lam * np.array([s for _, _, s in segments]) - log_k - math.log(n))[::-1]
    best = sum_tail(np.cumsum(normal)) - math.log(2) * np.arange(1, normal.size + 1)
    return max(0.0, float(best.max()))


# --- the model --------------------------------------------------------------


class Scorer:
    """Scores texts with a fitted model (a dict of arrays and numbers)."""

    def __init__(self, model: dict):
        self.m = model

    def token_scores(self, word: np.ndarray, stem: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores of the words of several texts; the k-th time that a word speaks for toxicity in a text it has 1/k of its log-odds."""
        out = _lookup(word, self.m["words"], self.m["word_scores"])
        missing = np.flatnonzero(np.isnan(out))
        found = _lookup(stem[missing], self.m["stems"], self.m["stem_scores"])
        out[missing] = np.where(np.isnan(found), 0.0, found)
        high = np.flatnonzero(out > self.m["drift"])
        if high.size:
            text = np.searchsorted(np.cumsum(counts), high, "right")
            order = np.lexsort((high, word[high], text))
            same = np.concatenate(([False], (word[high][order][1:] == word[high][order][:-1]) & (text[order][1:] == text[order][:-1])))
            place = np.arange(high.size)
            turn = place - np.maximum.accumulate(np.where(same, 0, place)) + 1
            out[high[order]] /= turn
        return out - self.m["drift"]

    def passages(self, texts: list[str | None]):
        """Yields, for each text, (words, segments, scores' evidence, byte spans of the words)."""
        for word, stem, counts, s, e, first in tokens_of(texts):
            scores = self.token_scores(word, stem, counts)
            at = 0
            for k, n in enumerate(counts):
                n = int(n)
                segments = maximal_segments(scores[at : at + n])
                yield n, segments, evidence(segments, n, self.m["lambda"], self.m["log_k"]), (s[at : at + n] - first[k], e[at : at + n] - first[k])
                at += n

    def probability(self, value: float) -> float:
        a, b = self.m["curve"]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(value)))))


def _lookup(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not table.size or not keys.size:
        return np.full(keys.size, np.nan)
    at = np.minimum(np.searchsorted(table, keys), table.size - 1)
    return np.where(table[at] == keys, values[at], np.nan)


def _sample(docs: DataFrame, labels: DataFrame, text: str, label: str, doc_id: str, fit_rows: int, fit_bytes: int) -> DataFrame:
    """(text, toxic, fold) of the ``fit_rows`` labelled training rows of each class with the smallest hashes, as long as they have ``fit_bytes`` together."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(~common.held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    # Each class has its own top-k, which every task cuts to fit_rows rows before they meet.
    parts = [known.where(F.col("toxic") == k).orderBy("order", "doc_id").limit(fit_rows) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # At most 2 * fit_rows identifiers, so the texts need not be shuffled to meet them.
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return _without_copies(common.within_bytes(picked, "text", "toxic", "order", fit_bytes).select("text", "toxic"))


def _without_copies(sample: DataFrame) -> DataFrame:
    """The sample with one text of those that share the smallest hash of their five-word shingles, under either of two orders, with its fold.

    Copies and near copies of one text would otherwise count as many documents for each of its words.
    """
    def keys(batches):
        for batch in batches:
            one, two = [], []
            for hashes, counts in words.word_hashes(batch.column(0).to_pylist()):
                shingles, each = words.shingle_hashes(hashes, counts, 5)
                low = 0
                for n in each:
                    part = shingles[low : low + int(n)]
                    low += int(n)
                    one.append(int(part.min().view(np.int64)) if n else 0)
                    two.append(int(words.mix(part).min().view(np.int64)) if n else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one, pa.int64()), pa.array(two, pa.int64())], [*batch.schema.names, "k1", "k2"])

    keyed = sample.mapInArrow(keys, "text string, toxic int, k1 long, k2 long")
    one = F.struct("text", "k1", "k2")
    for key in ("k1", "k2"):  # the smallest text stays, so that runs agree
        keyed = keyed.groupBy("toxic", key).agg(F.min(one).alias("r")).select("toxic", "r.text", "r.k1", "r.k2")
    return keyed.select("text", "toxic", F.pmod(F.xxhash64("k1"), F.lit(2)).cast("int").alias("fold"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> dict:
    """The model. Word counts of the sample are made on the executors; words met once go by their stem alone, which bounds what reaches the driver."""
    spark = docs.sparkSession
    common.small_batches(spark)
    sample = common.written(_sample(docs, labels, text, label, doc_id, fit_rows, fit_bytes), "toxicity-sample")

    def count(batches):
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            fold = np.array(batch.column(2).to_pylist(), np.int64)
            at = 0
            for word, stem, counts, *_ in tokens_of(batch.column(0).to_pylist()):
                low, keys, firsts, cells = 0, [], [], []
                for k, n in enumerate(counts):
                    key, index = np.unique(word[low : low + int(n)], return_index=True)
                    keys.append(key)
                    firsts.append(stem[low : low + int(n)][index])
                    cells.append(np.full(key.size, 2 * fold[at + k] + toxic[at + k]))
                    low += int(n)
                at += counts.size
                if not keys:
                    continue
                one, two, cell = np.concatenate(keys), np.concatenate(firsts), np.concatenate(cells)
                key, index, place = np.unique(one, return_index=True, return_inverse=True)
                made = [np.bincount(place[cell == c], minlength=key.size).astype(np.int64) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(two[index].view(np.int64)), *map(pa.array, made)], ["word", "stem", "c0", "t0", "c1", "t1"])

    sums = [F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")]
    counted = common.written(sample.mapInArrow(count, "word long, stem long, c0 long, t0 long, c1 long, t1 long").groupBy("word").agg(F.first("stem").alias("stem"), *sums), "toxicity-words")
    several = F.expr(f"c0 + t0 + c1 + t1 >= {LEAST_COUNT}")
    # As Arrow: a sample of rich words has millions of them, which as row objects take ten times the room.
    frame = counted.where(several).toArrow().to_pandas()
    stems = counted.groupBy("stem").agg(*sums).where(several).toArrow().to_pandas()
    per = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    model = {"words": np.empty(0, np.uint64), "word_scores": np.empty(0), "stems": np.empty(0, np.uint64), "stem_scores": np.empty(0), "drift": DRIFT, "lambda": 1.0, "log_k": 0.0, "curve": (-60.0, 0.0)}
    if not all(per.get((f, t)) for f in (0, 1) for t in (0, 1)) or frame.empty:
        return model
    frame = frame[frame["stem"].isin(stems["stem"])]

    def made(folds: tuple[int, ...]) -> dict:
        both = [[sum(x[f"{c}{f}"].to_numpy(float) for f in folds) for c in "tc"] for x in (frame, stems)]
        return lexicon(
            (frame["word"].to_numpy().view(np.uint64), frame["stem"].to_numpy().view(np.uint64), *both[0]), (stems["stem"].to_numpy().view(np.uint64), *both[1]),
            *[sum(per[f, t] for f in folds) for t in (1, 0)],
        )

    # Each half of the sample is scored by the words of the other half, so the calibration sees no text that its scores were made from.
    halves = [(sample.where(F.col("fold") == f), model | made((1 - f,))) for f in (0, 1)]
    model = _null_law(pd.concat([_facts(*half) for half in halves], ignore_index=True), model)
    law = {k: model[k] for k in ("lambda", "log_k")}
    found = pd.concat([_evidences(rows, own | law) for rows, own in halves], ignore_index=True)
    if found.empty:
        return model
    model["curve"] = logistic(np.log1p(found["evidence"].to_numpy()), found["toxic"].to_numpy(float))
    return model | made((0, 1))


def _collected(sample: DataFrame, model: dict, one, schema: str) -> pd.DataFrame:
    """What ``one(toxic, scores)`` makes of each sample text with a word (2 * fit_rows rows of a few numbers at most)."""
    shared = sample.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    made = T._parse_datatype_string(schema)

    def work(batches):
        target = to_arrow_schema(made)
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            toxic = batch.column(1).to_pylist()
            at, rows = 0, []
            for word, stem, counts, *_ in tokens_of(batch.column(0).to_pylist()):
                scores = scorer.token_scores(word, stem, counts)
                low = 0
                for n in counts.tolist():
                    if n:
                        rows.append(one(toxic[at], scores[low : low + n]))
                    low += n
                    at += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    found = sample.mapInArrow(work, schema).toPandas()
    shared.destroy()
    return found


def _facts(sample: DataFrame, model: dict) -> pd.DataFrame:
    """toxic, number of words, best segment, and a histogram of the token scores of the sample's texts."""

    def one(toxic: int, scores: np.ndarray) -> tuple:
        best = max((s for _, _, s in maximal_segments(scores)), default=0.0)
        return toxic, scores.size, best, np.bincount(np.clip(np.rint(scores * 4) + 64, 0, 128).astype(np.int64), minlength=129)

    return _collected(sample, model, one, "toxic int, n long, best double, hist array<long>")


def _evidences(sample: DataFrame, model: dict) -> pd.DataFrame:
    """toxic and evidence of the sample's texts."""

    def one(toxic: int, scores: np.ndarray) -> tuple:
        return toxic, evidence(maximal_segments(scores), scores.size, model["lambda"], model["log_k"])

    return _collected(sample, model, one, "toxic int, evidence double")


def _null_law(frame: pd.DataFrame, model: dict) -> dict:
    """The model with the extreme-value parameters."""
    clean = frame[frame["toxic"] == 0]
    if clean.empty:
        return dict(model)  # all scores then speak against toxicity
    values = (np.arange(129) - 64) / 4
    share = np.sum(np.stack(clean["hist"].to_list()), axis=0).astype(float)
    share /= share.sum()
    if share @ values >= 0 or not share[values > 0].any():
        share[0] += 1e-6
        share /= share.sum()
    lam = solve_lambda(values, share)
    # For a Gumbel law of lambda * best - ln n the mean is ln K + Euler's constant; the median is used, which stray labels move less.
    normal = lam * clean["best"] - np.log(clean["n"])
    return model | {"lambda": lam, "log_k": float(np.median(normal) + math.log(math.log(2)))}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic curve by Newton steps."""
    a = np.column_stack((np.ones_like(x), x))
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(2), a.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


SCORED = "score double, evidence double, segments int, passages array<struct<start:int,end:int,score:double,log_p:double>>"


def score(docs: DataFrame, model: dict, text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """``docs`` with score, evidence (-ln p), segments, and every significant passage (p < alpha): byte range in the lower-cased UTF-8 text, score, ln p."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # its size is bounded by the fit's sample; released with the frame
    base, schema, finish = common.with_input(docs, text, SCORED)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_p", pa.float64())]))

    def work(batches):
        scorer = Scorer(pickle.loads(shared.value))
        m = scorer.m
        for batch in batches:
            p, ev, count, spans = [], [], [], []
            for n, segments, value, (s, e) in scorer.passages(batch.columns[-1].to_pylist()):
                ev.append(value)
                p.append(scorer.probability(value))
                count.append(len(segments))
                found = []
                for a, b, x in segments:
                    expected = math.exp(min(700.0, m["log_k"] + math.log(n) - m["lambda"] * x))
                    chance = -math.expm1(-expected)
                    if chance < alpha:
                        found.append({"start": int(s[a]), "end": int(e[b - 1]), "score": x, "log_p": math.log(max(chance, 1e-300))})
                spans.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array(ev, pa.float64()), pa.array(count, pa.int32()), pa.array(spans, kind)], schema.names)

    return finish(base.mapInArrow(work, schema))


def drop_toxic(docs: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; same columns."""
    rows = common.packed(docs, text=F.col(common.quoted(text)))
    return score(rows, model, "text").where(F.col("score") < threshold).select("_row.*")
