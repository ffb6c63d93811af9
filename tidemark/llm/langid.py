"""Language ID by multilingual mixture inference.

Training (bounded, documented): for each language the ``fit_rows`` labelled
texts with the smallest hashes give counts of byte n-grams of words, turned into
smoothed log-probabilities by n-gram bucket. Only rows for training are read
for it; languages are those met there.

Inference, for every text: each word has a likelihood under each language (the
product over its n-grams), and a text is a mixture of languages with unknown
proportions, weighted by the words' letters (in bytes; a word of more than
LONG_WORD counts as one of so many, as its letters are not independent evidence).
Expectation-maximisation estimates the proportions, in EM_ROUNDS rounds at most
and fewer once no proportion moves by more than SETTLED. The language set is then
selected by penalised likelihood: starting with the best single language, the one
with the largest proportion among the others is added while twice the gain in
log-likelihood exceeds ``penalty`` times the logarithm of the evidence, and while
that proportion is above LEAST_SHARE in the mixture of all languages. A word
speaks against a language with a log-likelihood of FLOOR below its best at most, so
that one odd word can't rule a language out. The
prediction is the language with the largest proportion in that set.

Selection (``drop_unidentified``): a document stays if it has an identified
language and the leading one of its set has at least ``least_share`` of its
evidence; texts without letters, and mixtures that no language leads, go.

Defined cases: texts that are null or have no letter are ``und`` with score 0
and an empty set; digits and marks, those beyond ASCII too, are no evidence, and
neither are combining marks that follow no letter; ties go to the language that
comes first by name; texts are used whole; repeated rows get equal results; an
empty table gives an empty result; without any training row all are ``und``.
"""

from __future__ import annotations

import pickle
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common, words

FIT_ROWS, ORDERS, BITS, SMOOTHING, EM_ROUNDS, PENALTY, TEMPER = 3000, (1, 2, 3), 16, 0.5, 20, 2.0, 0.5
SETTLED, LEAST_SHARE, LONG_WORD, LEADING, FLOOR = 1e-3, 0.01, 12, 0.5, -30.0
_MULT = np.uint32(2654435761)
#: Marks that no letter carries.
_LONE_MARKS = regex.compile(r"(?<![\p{L}\p{M}])\p{M}+")


@lru_cache(maxsize=1 << 16)
def _is_mark(c: str) -> bool:
    """Whether a character beyond ASCII is neither a letter nor a mark that combines with one."""
    return unicodedata.category(c)[0] not in "LM"


def letters_only(text: str | None) -> bytes:
    """Lower-cased UTF-8 bytes with a blank for each character beyond ASCII that is no letter or combines with none; ASCII ones are told apart by their bytes."""
    text = text or ""
    if not text.isascii():
        beyond = [c for c in set(text) if c > "\x7f"]
        others = {ord(c): " " for c in beyond if _is_mark(c)}
        text = text.translate(others) if others else text
        if any(unicodedata.category(c)[0] == "M" for c in beyond):
            text = _LONE_MARKS.sub(lambda m: " " * len(m[0]), text)
    return words.encode(text)


def _letter_words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words.spans(buffer, words.LETTER_BYTE)


def ngram_buckets(buffer: np.ndarray) -> np.ndarray:
    """(orders, bytes): bucket of the n-gram that ends at each byte; other bytes than letters all count as a word border."""
    plain = np.where(words.LETTER_BYTE[buffer], buffer, 0).astype(np.uint32)
    out = np.empty((len(ORDERS), plain.size), np.int32)
    for row, n in enumerate(ORDERS):
        h = np.full(plain.size, n, np.uint32)
        for back in range(n):
            shifted = plain if not back else np.concatenate((np.zeros(min(back, plain.size), np.uint32), plain[:-back]))
            h = (h ^ shifted) * _MULT
            h ^= h >> np.uint32(15)
        out[row] = (h >> np.uint32(32 - BITS)).astype(np.int32)
    return out


def train(spark: SparkSession, docs: DataFrame, text: str, lang: str, doc_id: str, fit_rows: int = FIT_ROWS) -> dict:
    """Model from labelled rows: {languages, table (orders, buckets, languages) of log-probabilities}.

    The sample is the ``fit_rows`` rows of each language with the smallest hash of
    text and id; counts are made on the executors and only bucket totals (a
    number bounded by languages and buckets) reach the driver.
    """
    common.small_batches(spark)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text, doc_id).alias("order"))
    # A hash threshold well above the wanted share first, so that few rows meet in the exact choice.
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"languages": [], "table": np.zeros((len(ORDERS), 1 << BITS, 0), np.float32)}
    span = float(1 << 63) * 2
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(float(1 << 63), -float(1 << 63) + span * min(1.0, (fit_rows * 1.5 + 200) / n)))) for k, n in sizes.items()], F.lit(0.0))
    chosen = labelled.where(F.col("order").cast("double") <= limit)
    chosen = chosen.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("turn") <= fit_rows).select("lang", "text")

    def work(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for name in set(names):
                own = totals.setdefault(name, np.zeros((len(ORDERS), 1 << BITS)))
                for buffer, _ in words.pieces([letters_only(t) for t, k in zip(texts, names, strict=True) if k == name]):
                    inside = words.LETTER_BYTE[buffer]
                    for row, buckets in enumerate(ngram_buckets(buffer)):
                        own[row] += np.bincount(buckets[inside], minlength=1 << BITS)
        for name, own in totals.items():
            row, bucket = np.nonzero(own)
            n = row.size
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array(row.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(own[row, bucket].astype(np.int64))], ["lang", "row", "bucket", "n"]
            )

    counted = chosen.mapInArrow(work, "lang string, row int, bucket int, n long").groupBy("lang", "row", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    table = np.full((len(ORDERS), 1 << BITS, len(languages)), SMOOTHING)
    where = counted["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()
    if len(counted):
        table[counted["row"].to_numpy(), counted["bucket"].to_numpy(), where] += counted["n"].to_numpy()
    return {"languages": languages, "table": np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)}


def word_likelihoods(buffer: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words, and (words, languages) tempered log-likelihoods, each relative to the word's best."""
    s, e = _letter_words(buffer)
    if not s.size:
        return s, e, np.zeros((0, table.shape[2]), np.float32)
    inside = np.flatnonzero(words.LETTER_BYTE[buffer])
    total = np.zeros((inside.size, table.shape[2]), np.float32)
    for row, buckets in enumerate(ngram_buckets(buffer)):
        total += table[row][buckets[inside]]
    first = np.concatenate(([0], np.cumsum(e - s)[:-1]))
    out = np.add.reduceat(total, first, axis=0) * np.float32(TEMPER / len(ORDERS) * 2)
    return s, e - s, out - out.max(axis=1, keepdims=True)


def mixture(like: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, allowed: np.ndarray, rounds: int = EM_ROUNDS, settled: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (docs, languages) by expectation-maximisation, and log-likelihoods, of words (one at least) with likelihoods ``like``.

    ``doc``: document of each word, ascending; ``allowed``: (docs, languages)
    booleans. Rounds end early when no proportion has moved by more than ``settled``.
    """
    share = allowed / np.maximum(1, allowed.sum(axis=1, keepdims=True))
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    present = doc[start]
    total = np.add.reduceat(weight, start)
    for _ in range(rounds):
        part = share[doc] * like
        norm = part.sum(axis=1)
        part *= (weight / norm)[:, None]
        before, now = share[present], np.add.reduceat(part, start, axis=0) / total[:, None]
        share[present] = now
        if np.abs(now - before).max() <= settled:
            break
    log = np.full(docs, 0.0)
    log[present] = np.add.reduceat(weight * np.log((share[doc] * like).sum(axis=1)), start)
    return share, log


def infer(texts: list[str | None], model: dict, penalty: float = PENALTY) -> list[tuple[str, float, dict[str, float]]]:
    """(prediction, its proportion, proportions of the selected languages) for each text."""
    languages, table = model["languages"], model["table"]
    out: list[tuple[str, float, dict[str, float]]] = []
    if not languages:
        return [("und", 0.0, {})] * len(texts)
    for buffer, ends in words.pieces([letters_only(t) for t in texts]):
        s, n, log_like = word_likelihoods(buffer, table)
        docs = ends.size
        if not s.size:
            out += [("und", 0.0, {})] * docs
            continue
        doc = np.searchsorted(ends, s, "right")
        has = np.zeros(docs, bool)
        has[doc] = True
        like = np.exp(np.maximum(log_like, FLOOR)).astype(np.float64)
        weight = np.minimum(n, LONG_WORD) / 6.0
        evidence = np.bincount(doc, weight, docs)
        k = len(languages)
        # Best single language, then forward selection.
        single = np.stack([np.bincount(doc, weight * np.maximum(log_like[:, i], FLOOR), docs) for i in range(k)], axis=1)
        chosen = np.zeros((docs, k), bool)
        chosen[np.arange(docs), single.argmax(axis=1)] = True
        best = single.max(axis=1)
        full, _ = mixture(like, weight, doc, docs, np.ones((docs, k), bool), settled=SETTLED)
        share = chosen.astype(float)
        cost = penalty * np.log(np.maximum(2.0, evidence))
        growing = has.copy()
        for _ in range(k - 1):
            # The candidate is the language with the largest proportion in the unrestricted mixture.
            left = np.where(chosen, -1.0, full)
            candidate = left.argmax(axis=1)
            growing &= left.max(axis=1) > LEAST_SHARE
            if not growing.any():
                break
            trial = chosen.copy()
            trial[np.arange(docs), candidate] = True
            mine = growing[doc]
            new, log = mixture(like[mine], weight[mine], doc[mine], docs, trial, settled=SETTLED)
            better = growing & (2 * (log - best) > cost)
            chosen[better], share[better], best[better] = trial[better], new[better], log[better]
            growing = better
        top = share.argmax(axis=1)
        for i in range(docs):
            if not has[i]:
                out.append(("und", 0.0, {}))
            else:
                out.append((languages[top[i]], float(min(1.0, share[i, top[i]])), {languages[j]: float(share[i, j]) for j in np.flatnonzero(chosen[i])}))
    return out


def predict(docs: DataFrame, model: dict, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_pred, score (the language's proportion) and lang_mix (map of the selected languages' proportions)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # size bounded by languages, orders and buckets; released with the frame
    base, schema, finish = common.with_input(docs, text, "lang_pred string, score double, lang_mix map<string,double>")

    def work(batches):
        own = pickle.loads(shared.value)
        for batch in batches:
            made = infer(batch.columns[-1].to_pylist(), own, penalty)
            mix = pa.array([list(m.items()) for _, _, m in made], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), mix], schema.names)

    return finish(base.mapInArrow(work, schema))


def train_on(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_rows: int = FIT_ROWS) -> dict:
    """Model from the rows that are not held out."""
    return train(docs.sparkSession, docs.where(~common.held_out(F.col(doc_id))), text, lang, doc_id, fit_rows)


def drop_unidentified(docs: DataFrame, model: dict, text: str = "text", penalty: float = PENALTY, least_share: float = LEADING) -> DataFrame:
    """``docs`` without the rows that have no language, or whose leading language has less than ``least_share``; same columns."""
    rows = common.packed(docs, text=F.col(common.quoted(text)))
    return predict(rows, model, "text", penalty).where((F.col("lang_pred") != "und") & (F.col("score") >= least_share)).select("_row.*")
