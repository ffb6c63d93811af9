"""Scores of toxicity, quality and language against plain loops over the fitted models."""

import math
import re
import unicodedata

import numpy as np
import pytest

from tidemark.llm import common, langid, quality, toxicity, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return [r.text for r in docs.orderBy("doc_id").collect()] + [None, "", "!! 12", "Déjà vu — «oui» 。", "word " * 20000]


def hash_of(part: bytes) -> int:
    one = words.span_hashes(np.frombuffer(part + b"\n", np.uint8), np.array([0]), np.array([len(part)]))
    return int(one[0])


def split_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())


def segments_of(scores):
    """Maximal scoring segments by the definition of the scan, one token at a time."""
    parts, total = [], 0.0  # left sum, right sum, start, end
    for k, s in enumerate(scores):
        total += s
        if s <= 0:
            continue
        new = [total - s, total, k, k + 1]
        while True:
            j = len(parts) - 1
            while j >= 0 and parts[j][0] >= new[0]:
                j -= 1
            if j < 0 or parts[j][1] >= new[1]:
                parts.append(new)
                break
            new = [parts[j][0], new[1], parts[j][2], new[3]]
            del parts[j:]
    return [(a, b, r - left) for left, r, a, b in parts]


def tail_of(r, t):
    """P(sum of the r best normalised scores >= t) by an integral over ln of the r-th arrival; its Chernoff bound beyond 32."""
    if r > toxicity.EXACT_SUMS:
        moment = lambda x: -(r - 1) * math.log(1 - x) + math.lgamma(r * (1 - x)) - math.lgamma(r)
        return math.exp(min(0.0, *(moment(x) - x * t for x in toxicity.THETAS.tolist())))
    if r == 1:
        return -math.expm1(-math.exp(-t))
    u = np.linspace(min(-t / r, 0.0) - 60 / r, math.log(r + 10 * math.sqrt(r) + 20), 6000)
    x = np.maximum(t + r * u, 0.0)
    above, term = np.zeros(u.size), np.exp(-x)  # P(a gamma variable of r - 1 steps is above x)
    for k in range(r - 1):
        above, term = above + term, term * x / (k + 1)
    return float(np.exp(r * u - np.exp(u) - math.lgamma(r)) @ np.where(t + r * u <= 0, 1.0, above)) * (u[1] - u[0])


def evidence_of(scores, n, lam, log_k):
    best = total = 0.0
    for r, x in enumerate(sorted((lam * s - log_k - math.log(n) for s in scores), reverse=True), 1):
        total += x
        best = max(best, -math.log(max(tail_of(r, total), 1e-300)) - r * math.log(2))
    return best


def test_toxicity_scores(spark, docs, texts):
    model = toxicity.fit(docs, common.table(spark, SF, "labels"))
    lexicon, stems = dict(zip(model["words"].tolist(), model["word_scores"], strict=True)), dict(zip(model["stems"].tolist(), model["stem_scores"], strict=True))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    for k, text in enumerate(texts):
        found, seen = split_words(text), {}
        scores = []
        for w in found:
            key = hash_of(w)
            value = lexicon.get(key)
            if value is None:
                value = stems.get(hash_of(w[: toxicity.STEM_BYTES]) ^ 0x5DEECE66D, 0.0)
            if value > model["drift"]:
                seen[key] = seen.get(key, 0) + 1
                value /= seen[key]
            scores.append(value - model["drift"])
        value = evidence_of([s for _, _, s in segments_of(scores)], len(found), model["lambda"], model["log_k"]) if found else 0.0
        assert got[k].evidence == pytest.approx(value, abs=0.02, rel=2e-3)
        a, b = model["curve"]
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * math.log1p(got[k].evidence))))), abs=1e-9)


def test_evidence_uses_every_segment():
    values = [toxicity.evidence([(k, k + 1, 9.0) for k in range(n)], 1000, 1.0, 0.0) for n in (1, 31, 60, 100, 500)]
    assert values == sorted(set(values))
    for n in (2, 20, 100):
        assert values[3] > 0 and toxicity.evidence([(0, 1, 9.0)] * n, 1000, 1.0, 0.0) == pytest.approx(evidence_of([9.0] * n, 1000, 1.0, 0.0), rel=2e-3)
    mixed = [float(s) for s in np.random.default_rng(5).exponential(4, 70)]
    assert toxicity.evidence([(0, 1, s) for s in mixed], 400, 0.7, 0.3) == pytest.approx(evidence_of(mixed, 400, 0.7, 0.3), abs=0.02)


def test_evidence_never_falls_when_a_segment_rises():
    rng = np.random.default_rng(6)
    for _ in range(10_000):
        scores = rng.normal(rng.normal(4, 4), rng.uniform(0.1, 4), int(rng.integers(1, 90)))
        more = scores.copy()
        more[rng.integers(scores.size)] += rng.exponential(rng.choice([0.01, 1, 10]))
        one, two = (toxicity.evidence([(0, 1, float(x)) for x in s], 100, 1.0, 0.0) for s in (scores, more))
        assert two >= one - 1e-9


def test_tails_agree_with_draws_of_the_null_law():
    """The best scores are -ln of the arrivals of a Poisson process: exact within the draws' error, and never below it for long sums."""
    draws = 100_000
    sums = np.cumsum(-np.log(np.cumsum(np.random.default_rng(7).exponential(size=(draws, 50)), axis=1)), axis=1)
    for r in (1, 2, 3, 7, 15, 32, 33, 50):
        for share in (0.5, 0.1, 0.01, 0.001):
            totals = np.zeros(r)
            totals[-1] = np.quantile(sums[:, r - 1], 1 - share)
            p = math.exp(-toxicity.sum_tail(totals)[-1])
            error = 4 * math.sqrt(share / draws)
            assert p > share - error if r > toxicity.EXACT_SUMS else abs(p - share) < error + 0.004 * share


def test_many_weak_segments_weigh_less_than_as_many_strong_ones():
    """Sums near zero are no evidence in themselves."""
    of = lambda normal: toxicity.evidence([(0, 1, x + math.log(100)) for x in normal], 100, 1.0, 0.0)
    assert of([0.5, -0.499]) <= of([0.5, 0.5]) and of([0.1] * 10) < of([1.0] * 10) < of([2.0] * 10)
    assert of([0.9] + [-0.09] * 9) < of([0.9] * 10)


def test_quality_scores(spark, docs, texts):
    model = quality.fit(docs, common.table(spark, SF, "labels"), quality.label_grade(), 3)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.grade_documents(frame, model).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").lower().encode()
        found, marks = split_words(text), re.findall(rb"[^0-9a-z\x80-\xff\t\n\x0b\x0c\r \x00]+", raw)
        keys = [hash_of(w) for w in found]
        pairs = [int(words.mix(np.array([a * 3 + b & (1 << 64) - 1], np.uint64))[0]) for a, b in zip(keys[:-1], keys[1:], strict=True)]
        counts = {}
        for h in [*keys, *[hash_of(m) for m in marks], *pairs]:
            counts[h >> 64 - quality.BITS] = counts.get(h >> 64 - quality.BITS, 0) + 1
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values())) or 1.0
        z = sum(2 * math.log1p(n) / norm * model["weights"][b] for b, n in counts.items())
        size = max(1, len(raw))
        letters = len(re.findall(rb"[a-z\x80-\xff]", raw))
        form = [
            letters / size, sum(map(len, marks)) / size, len(set(keys)) / len(keys) if keys else 0.0, max(map(keys.count, set(keys))) / len(keys) if keys else 0.0,
            min(1.0, math.log1p(len(keys)) / 12), len(marks) / max(1, len(keys) + len(marks)), min(1.0, size / max(1, len(keys)) / 16), float(not keys),
        ]
        z += sum(0.5 * model["weights"][(1 << quality.BITS) + i * 64 + min(63, int(x * 63 + 0.5))] for i, x in enumerate(form))
        want = [1 / (1 + math.exp(-(z - c))) for c in model["cuts"]]
        assert got[k].tails == pytest.approx(want, abs=1e-6) and got[k].expected_grade == pytest.approx(sum(want), abs=1e-6)


def test_language_mixtures(spark, docs, texts):
    model = langid.train_on(docs)
    names, table = model["languages"], model["table"].astype(float)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts) if len(t or "") < 3000], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(frame, model).collect()}
    for k in got:
        kept = "".join(c if c.isascii() or unicodedata.category(c)[0] in "LM" else " " for c in texts[k] or "")
        raw = kept.lower().encode() + b"\n"
        like, weight = [], []
        buckets = langid.ngram_buckets(np.frombuffer(raw, np.uint8))
        for m in re.finditer(rb"[a-z\x80-\xff]+", raw):
            total = [sum(table[o][buckets[o][p]][i] for o in range(len(langid.ORDERS)) for p in range(*m.span())) * langid.TEMPER / len(langid.ORDERS) * 2 for i in range(len(names))]
            like.append([max(-30.0, x - max(total)) for x in total])
            weight.append(min(len(m[0]), langid.LONG_WORD) / 6)
        if not like:
            assert (got[k].lang_pred, got[k].score, got[k].lang_mix) == ("und", 0.0, {})
            continue

        def mixture(chosen, like=like, weight=weight):
            share = {i: 1 / len(chosen) for i in chosen}
            for _ in range(langid.EM_ROUNDS):
                parts = dict.fromkeys(chosen, 0.0)
                for row, w in zip(like, weight, strict=True):
                    norm = sum(share[i] * math.exp(row[i]) for i in chosen)
                    for i in chosen:
                        parts[i] += w * share[i] * math.exp(row[i]) / norm
                before, share = share, {i: p / sum(weight) for i, p in parts.items()}
                if max(abs(share[i] - before[i]) for i in chosen) <= 1e-6:
                    break
            return share, sum(w * math.log(sum(share[i] * math.exp(row[i]) for i in chosen)) for row, w in zip(like, weight, strict=True))

        single = [sum(w * row[i] for row, w in zip(like, weight, strict=True)) for i in range(len(names))]
        chosen, best = [int(np.argmax(single))], max(single)
        share = {chosen[0]: 1.0}
        full, _ = mixture(list(range(len(names))))
        cost = langid.PENALTY * math.log(max(2.0, sum(weight)))
        close = False
        while len(chosen) < len(names):
            candidate = max((i for i in full if i not in chosen), key=lambda i: full[i])
            close |= abs(full[candidate] - langid.LEAST_SHARE) < 5e-3
            if full[candidate] <= langid.LEAST_SHARE:
                break
            new, log = mixture([*chosen, candidate])
            close |= abs(2 * (log - best) - cost) < 0.5
            if 2 * (log - best) <= cost:
                break
            chosen, share, best = [*chosen, candidate], new, log
        if close:
            continue  # rounds that end a little earlier may decide otherwise
        assert set(got[k].lang_mix) == {names[i] for i in chosen}, k
        assert all(got[k].lang_mix[names[i]] == pytest.approx(share[i], abs=0.03) for i in chosen)
        assert got[k].lang_mix[got[k].lang_pred] == pytest.approx(max(share.values()), abs=0.03)


def test_language_ties_marks_and_selection(spark):
    model = {"languages": ["aa", "bb"], "table": np.zeros((len(langid.ORDERS), 1 << langid.BITS, 2), np.float32)}
    assert langid.infer(["some words"], model)[0][0] == "aa"  # equal likelihoods: the first by name
    assert langid.letters_only("A — «b»。é 你") == "a    b  é 你".encode()
    starts, ends = langid.words.spans(np.frombuffer(langid.letters_only("abc — « 。"), np.uint8), langid.words.LETTER_BYTE)
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 3)]


def test_documents_that_no_language_leads_go(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train_on(docs)
    parts = {k: docs.where(f"lang = '{k}' and length(text) > 800").first().text[:800] for k in model["languages"]}
    assert len(parts) >= 3
    rows = [(1, parts[model["languages"][0]]), (2, "\n".join(parts.values())), (3, "1234 !!"), (4, None)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    kept = langid.drop_unidentified(frame, model)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == ["doc_id", "text", "score"]
