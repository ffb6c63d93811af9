"""The divergence audit against sums over all terms of all pairs, in Python's integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence

ROWS = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=10, top=10):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: {t: c[t] for t in kept} for (k, s), c in counts.items() if k == lang}

        def p(count, total):
            return 1 + 10**9 * (count + 2) // (total + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        all_n = {t: sum(c[t] for c in own.values()) for t in kept}
        for s, c in own.items():
            mine = {t: p(c[t], sum(c.values())) for t in kept}
            pairs = [(sum(f(mine[t], p(c2[t], sum(c2.values()))) for t in kept), o) for o, c2 in own.items() if o != s]
            terms = [(f(mine[t], q), t) for t in kept if c[t] and mine[t] > (q := p(all_n[t], sum(all_n.values())))]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(150)] + ["É", "été", "日本", "naïve-x", "U.S", "12ab"]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(n):
        lang, source = ["aa", "bb", None, ""][int(rng.choice(4, p=[0.6, 0.3, 0.05, 0.05]))], f"s{int(rng.integers(0, 9) if k % 3 else 0)}"
        picked = rng.choice(words, int(rng.integers(0, 60)), p=np.roll(weights, int(source[1])) / weights.sum())
        rows.append((k, " ".join(picked).title() if k % 5 == 0 else " ".join(picked), lang, None if source == "s8" else source))
    return [*rows, (n, None, "aa", "only nulls"), (n + 1, "", "empty", "one"), (n + 2, "rare terms", "empty", "two"), (n + 3, "lonely", "single", None), *rows[:3]]


@pytest.mark.parametrize(("block_groups", "held"), [(128, 300_000), (2, 300_000), (3, 20)])
def test_equal_to_all_sums(spark, monkeypatch, block_groups, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = corpus(1)
    got = divergence.audit(spark.createDataFrame(rows, ROWS).repartition(5), block_groups=block_groups)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_names_and_limits(spark):
    rows = corpus(2, 150)
    frame = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("term", "value", "rank", "n", "p")})
    assert sorted(map(tuple, divergence.audit(frame, least_docs=3, top_terms=2).collect())) == brute(rows, 3, 2)


def test_large_counts_stay_exact(spark):
    """Counts whose product with 10^9 passes 2^63."""
    row = spark.createDataFrame([(10**15, 3 * 10**15, 7)], "c long, n long, v long")
    assert row.select(divergence.chance("c", "n", "v")).first()[0] == 1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 14)


def test_terms_are_cut_before_they_meet(spark):
    plan = divergence.audit(spark.createDataFrame(corpus(3, 60), ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], ROWS)).count() == 0
