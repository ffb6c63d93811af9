"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds t_1 < ... < t_G cut the score line: P(grade >= g) = s(w x - t_g), s
the logistic function. The model gives the expected grade (the sum of the tail
probabilities) and each tail probability, by which documents are selected.

Features of a whole text: words, runs of marks, and pairs of neighbouring words,
hashed into buckets with log(1 + count) and unit length, beside a few measures
of form (share of marks, of letters, of distinct words, of the most common
word, length), in steps. The fit is by full-batch gradient steps with a ridge, on
the ``fit_rows`` rated texts of each grade with the smallest hashes (bounded,
documented), weighted so that grades count as often as in the ratings. Of those,
texts join the sample in hash order as long as the grade's have ``fit_bytes``
together, so what the driver fits on is bounded in bytes too; no text is cut, and
one of more than that by itself is passed over.

Defined cases: null and empty texts have only form features; without a rated
row, with ratings of one grade only, or of no document at hand, tails are the
grades' shares in the ratings; thresholds never cross; of several ratings of an
id the highest counts; rows that repeat an id are in the sample each; ties of
hashes go to the smaller id; texts are scored whole at any length; repeated rows
get equal results; an empty table gives an empty result; other columns pass
through, but for those named as the made ones.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, words

FIT_ROWS, FIT_BYTES, BITS, RIDGE, STEPS, RATE = 2500, 16 << 20, 16, 1e-4, 250, 0.3
_FORM = 64
SIZE = (1 << BITS) + 8 * _FORM


# --- features ---------------------------------------------------------------


def features(texts: list[str | None]):
    """Yields CSR parts (counts of features by text, buckets, values) for runs of consecutive texts."""
    for buffer, ends in words.pieces([words.encode(t) for t in texts]):
        first = np.concatenate(([0], ends))
        s, e = words.spans(buffer)
        word = words.span_hashes(buffer, s, e)
        ms, me = words.spans(buffer, words.MARK_BYTE)
        mark = words.span_hashes(buffer, ms, me)
        w_at, m_at = np.searchsorted(s, first), np.searchsorted(ms, first)
        letters = np.concatenate(([0], np.cumsum(words.LETTER_BYTE[buffer])))
        marks = np.concatenate(([0], np.cumsum(words.MARK_BYTE[buffer])))
        counts, buckets, values = [], [], []
        for k in range(ends.size):
            w, m = word[w_at[k] : w_at[k + 1]], mark[m_at[k] : m_at[k + 1]]
            pair = words.mix(w[:-1] * np.uint64(3) + w[1:]) if w.size > 1 else w[:0]
            index, n = np.unique((np.concatenate((w, m, pair)) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
            value = np.log1p(n)
            norm = np.sqrt((value**2).sum()) or 1.0
            size = max(1, int(first[k + 1] - first[k]) - 1)
            if w.size:
                seen = np.unique(w, return_counts=True)[1]
                spread, top = seen.size / w.size, seen.max() / w.size
            else:
                spread, top = 0.0, 0.0
            form = [
                (letters[first[k + 1]] - letters[first[k]]) / size, (marks[first[k + 1]] - marks[first[k]]) / size, spread, top,
                min(1.0, np.log1p(w.size) / 12), m.size / max(1, w.size + m.size), min(1.0, size / max(1, w.size) / 16), float(not w.size),
            ]
            steps = [(1 << BITS) + i * _FORM + min(_FORM - 1, int(x * (_FORM - 1) + 0.5)) for i, x in enumerate(form)]
            counts.append(index.size + len(steps))
            buckets += [index, np.array(steps)]
            values += [value / norm * 2, np.full(len(steps), 0.5)]
        yield np.array(counts), np.concatenate(buckets), np.concatenate(values)


# --- the model --------------------------------------------------------------


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_cumulative(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, size: int = SIZE, ridge: float = RIDGE, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by AdaGrad on the mean log-loss of the grade's interval; thresholds are a first one and positive gaps."""
    n = grade.size
    tail = np.array([(weight * (grade >= g)).sum() / weight.sum() for g in range(1, grades)])
    base = -np.log(np.clip(tail, 1e-4, 1 - 1e-4) / (1 - np.clip(tail, 1e-4, 1 - 1e-4)))
    first, gaps = float(base[0]), np.log(np.maximum(np.diff(base), 1e-2))
    w = np.zeros(size)
    sums = [np.full(size, 1e-6), 1e-6, np.full(gaps.size, 1e-6)]
    share = weight / weight.sum()
    for _ in range(steps):
        cuts = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        z = np.bincount(row, value * w[bucket], n)
        above = np.concatenate((np.ones((n, 1)), _sigmoid(z[:, None] - cuts), np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        high, low = above[at, grade], above[at, grade + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        d_z = -share * (d_high - d_low)
        d_cut = np.zeros(grades + 1)
        np.add.at(d_cut, grade, share * d_high)
        np.add.at(d_cut, grade + 1, -share * d_low)
        d_cut = d_cut[1:grades]
        grads = [np.bincount(bucket, value * d_z[row], size) + ridge * w, d_cut.sum(), np.array([d_cut[i + 1 :].sum() * np.exp(gaps[i]) for i in range(gaps.size)])]
        for k in range(3):
            sums[k] = sums[k] + grads[k] ** 2
        w -= rate * grads[0] / np.sqrt(sums[0])
        first -= rate * 0.2 * grads[1] / np.sqrt(sums[1])
        gaps = np.clip(gaps - rate * 0.2 * grads[2] / np.sqrt(sums[2]), -5, 4)
    return w, first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, text: str = "text", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> dict:
    """Model from the ratings of rows that are not held out. ``grade``: integer column of ``ratings``, 0 to grades - 1; other values and nulls are no ratings."""
    spark = docs.sparkSession
    common.small_batches(spark)
    known = ratings.select(F.col(doc_id).alias("doc_id"), grade.cast("int").alias("grade")).where(f"grade between 0 and {grades - 1} and doc_id is not null").where(~common.held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("grade").alias("grade")).withColumn("order", F.xxhash64("doc_id"))
    sizes = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    tails = [sum(n for g, n in sizes.items() if g >= k) / total if total else 0.0 for k in range(1, grades)]
    model = {"weights": np.zeros(SIZE), "cuts": -np.log(np.clip(tails, 1e-6, 1 - 1e-6) / (1 - np.clip(tails, 1e-6, 1 - 1e-6))), "grades": grades}
    if len(sizes) < 2:
        return model
    limit = F.lit(0.0)
    for g, n in sizes.items():
        limit = F.when(F.col("grade") == g, F.lit(-float(1 << 63) + min(1.0, (1.5 * fit_rows + 200) / n) * 2 * float(1 << 63))).otherwise(limit)
    turn = F.row_number().over(Window.partitionBy("grade").orderBy("order", "doc_id"))
    chosen = known.where(F.col("order").cast("double") <= limit).withColumn("turn", turn).where(F.col("turn") <= fit_rows).select("doc_id", "grade", "turn")
    # At most grades * fit_rows identifiers, so the texts need not be shuffled to meet them.
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = common.within_bytes(sample, "text", "grade", "turn", fit_bytes).select("text", "grade")

    def work(batches):
        for batch in batches:
            index, value = [], []
            for counts, buckets, values in features(batch.column(0).to_pylist()):
                at = np.concatenate(([0], np.cumsum(counts)))
                index += [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                value += [values[a:b].astype(np.float32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["grade", "buckets", "vals"])

    frame = sample.mapInArrow(work, "grade int, buckets binary, vals binary").toPandas()
    if frame.empty:
        return model
    parts = [np.frombuffer(b, np.int32) for b in frame["buckets"]]
    row = np.repeat(np.arange(len(parts)), [p.size for p in parts])
    grade_of = frame["grade"].to_numpy()
    met = np.bincount(grade_of, minlength=grades)
    weight = np.array([sizes.get(g, 0) / max(1, met[g]) for g in range(grades)])[grade_of]
    values = np.concatenate([np.frombuffer(b, np.float32) for b in frame["vals"]]).astype(float)
    w, cuts = fit_cumulative(row, np.concatenate(parts).astype(np.int64), values, grade_of, weight, grades)
    return model | {"weights": w, "cuts": cuts}


def tails(texts: list[str | None], model: dict) -> np.ndarray:
    """(texts, grades - 1): probability of each grade from 1 on, or higher."""
    out = []
    for counts, buckets, values in features(texts):
        row = np.repeat(np.arange(counts.size), counts)
        z = np.bincount(row, values * model["weights"][buckets], counts.size)
        out.append(_sigmoid(z[:, None] - model["cuts"]))
    return np.concatenate(out) if out else np.zeros((0, model["grades"] - 1))


def grade_documents(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with expected_grade double and tails array<double> (P(grade >= 1), P(grade >= 2), ...)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # a fixed number of weights
    base, schema, finish = common.with_input(docs, text, "expected_grade double, tails array<double>")

    def work(batches):
        own = pickle.loads(shared.value)
        for batch in batches:
            p = tails(batch.columns[-1].to_pylist(), own)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p.sum(axis=1)), pa.array(p.tolist(), pa.list_(pa.float64()))], schema.names)

    return finish(base.mapInArrow(work, schema))


def select(docs: DataFrame, model: dict, grade: int, least: float, text: str = "text") -> DataFrame:
    """``docs`` whose probability of the grade or a higher one is ``least`` or more; same columns."""
    rows = common.packed(docs, text=F.col(common.quoted(text)))
    return grade_documents(rows, model, "text").where(F.col("tails")[grade - 1] >= least).select("_row.*")


def label_grade() -> Column:
    """Grades of the table ``labels``: 0 poor, 1 good but toxic, 2 good and not toxic; null where quality is."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 1), 1).when(F.col("quality") == 1, 2)
