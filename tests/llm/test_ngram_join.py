"""N-gram Jaccard join against brute force."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, words
from tidemark.llm.components import connected


def shingles(text, n=5):
    found = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def brute(rows, threshold=0.8):
    links = {k: 0 for k in range(len(rows))}
    group = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    ids = {}
    for g, (i, _) in zip(group, rows, strict=True):
        ids[g] = min(ids.get(g, i), i)
    return sorted((i, ids[g], links[k]) for k, (g, (i, _)) in enumerate(zip(group, rows, strict=True)))


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 60, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, "!!! ..."), (len(rows) + 3, "One"), (len(rows) + 4, "one.")]
    return rows


@pytest.mark.parametrize("block", [3, 128])
def test_classes_and_links_equal_brute_force(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicate_classes(docs, block=block).collect())
    assert got == brute(rows)


def test_pairs_and_stage(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    for r in ngram_join.similar_pairs(docs).collect():
        a, b = sets[r.id_a], sets[r.id_b]
        assert r.jaccard == pytest.approx(len(a & b) / len(a | b)) and r.jaccard >= 0.8
    kept = sorted(r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect())
    assert kept == sorted({c for _, c, _ in brute(rows)})


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (None, None), (3, "short one")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.class_id, r.n_links) for r in ngram_join.near_duplicate_classes(docs).collect()), key=str)
    assert (False, 1, 1, 2) in got and (True, None, 1, 2) in got and (True, None, None, 0) in got and (False, 3, 3, 0) in got
    kept = [r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 3] and kept.count(None) == 2
    empty = docs.where("doc_id > 5")
    assert ngram_join.near_duplicate_classes(empty).count() == 0 and ngram_join.drop_near_duplicates(empty).count() == 0


def test_bands_reach_recall():
    for threshold, recall in ((0.8, 0.9999), (0.8, 0.99), (0.5, 0.9)):
        b, r = ngram_join.bands_for(threshold, recall, 128)
        assert 1 - (1 - threshold**r) ** b >= recall and b * r <= 128
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.1, 0.9999, 16)


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.node: r.c for r in connected(spark.createDataFrame(edges, "a long, b long"), "c").collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}, 300: 300, 301: 300}


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = ["Ab cd", None, "", "é1 x " * 500, "  q"]
    one = [(h.tolist(), c.tolist()) for h, c in words.word_hashes(texts)]
    monkeypatch.setattr(words, "PIECE", 16)
    many = [(h.tolist(), c.tolist()) for h, c in words.word_hashes(texts)]
    assert sum((h for h, _ in one), []) == sum((h for h, _ in many), [])
    assert sum((c for _, c in one), []) == sum((c for _, c in many), [])


def test_chains_and_pairs_are_whole(spark):
    """A chain of texts, each linked to the next alone: all links are found, and what is verified grows with the chain."""
    n, step, size = 5000, 20, 200
    rows = [(k, " ".join(f"v{j}" for j in range(k * step, k * step + size))) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    sets = {i: shingles(t) for i, t in rows}
    near = {(a, b) for a in range(n) for b in range(a + 1, min(n, a + 3)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near) in (0, n - 1)
    got = {(r.id_a, r.id_b) for r in ngram_join.similar_pairs(docs).collect()}
    assert got == near
    classes = ngram_join.near_duplicate_classes(docs).collect()
    assert len({r.class_id for r in classes}) == n - len(near)
    _, found, _ = ngram_join._sketched(docs, "text", "doc_id", 5, 0.8, 0.9999, 128)
    buckets = ngram_join._buckets(found)
    assert buckets.count() <= 24 * n and (buckets.agg({"members": "max"}).first()[0] or 0) < 60


def test_pairs_are_complete(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    sets, first = {i: shingles(t) for i, t in rows}, {}
    for i, _ in rows:
        first.setdefault(frozenset(sets[i]), i)
    ids = sorted(v for k, v in first.items() if k)
    want = {(a, b) for a, b in combinations(ids, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for block, size in ((128, 1 << 20), (2, 1 << 20), (128, 900)):
        assert {(r.id_a, r.id_b) for r in ngram_join.similar_pairs(docs, block=block, block_bytes=size).collect()} == want


def test_equal_filter_hashes_lose_and_confuse_no_row(spark, monkeypatch):
    """All rows share the hash that places them in filters; the whole key still tells them apart."""
    base = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(6)]
    rows = [(10 * k + j, t + (" tail" if j == 2 else "")) for k, t in enumerate(base) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(map(tuple, ngram_join.near_duplicate_classes(docs).select("doc_id", "class_id", "n_links").collect()))
    monkeypatch.setattr(ngram_join, "_filter_hash", lambda text, doc_id: F.lit(5).cast("long"))
    assert sorted(map(tuple, ngram_join.near_duplicate_classes(docs).select("doc_id", "class_id", "n_links").collect())) == plain
    assert plain == sorted((10 * k + j, 10 * k, 2) for k in range(6) for j in range(3))
    assert sorted(r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()) == [10 * k for k in range(6)]
