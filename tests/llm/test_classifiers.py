"""Toxicity, quality and language: held-out accuracy, brute force of their parts, and edge cases."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def brute_segments(scores):
    """Maximal segments by their definition: the best, shortest and earliest, then the same on both sides."""
    def inside(low, high):
        best = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and j + 1 - i < best[1] - best[0])):
                    best = (i, j + 1, total)
        if best is None:
            return []
        return [*inside(low, best[0]), best, *inside(best[1], high)]

    return inside(0, len(scores))


def test_segments_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        scores = np.array([rng.choice([-3.1, -1.3, -0.7, 0.9, 1.7, 4.3]) + rng.random() / 100 for _ in range(rng.randint(0, 14))])
        got = toxicity.maximal_segments(scores)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_lambda_solves_its_equation():
    values, share = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    assert toxicity.solve_lambda(values, share) == pytest.approx(np.log(3))


def test_evidence_grows_with_score_and_number_of_segments():
    one = toxicity.evidence([(0, 1, 9.0)], 100, 1.0, 0.0)
    assert toxicity.evidence([(0, 1, 12.0)], 100, 1.0, 0.0) > one > toxicity.evidence([(0, 1, 9.0)], 1000, 1.0, 0.0)
    assert toxicity.evidence([(0, 1, 9.0), (5, 6, 9.0)], 100, 1.0, 0.0) > one
    assert toxicity.evidence([], 100, 1.0, 0.0) == 0.0


@pytest.fixture(scope="module")
def tables(spark):
    return common.table(spark, SF, "documents"), common.table(spark, SF, "labels")


def edge_rows(spark):
    return spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "!!! 123", "a"), (3, "!!! 123", "a"), (None, "word " * 60000, "a")], "doc_id long, text string, n string")


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).toPandas()
    predicted = scored["score"] >= 0.3
    assert (predicted == (scored["toxic"] == 1)).mean() > 0.93 and scored["score"].between(0, 1).all()
    assert predicted[scored["toxic"] == 0].mean() < 0.06
    text = docs.join(scored_ids(spark, scored[scored["score"] > 0.9]["doc_id"].tolist()), "doc_id").first()
    again = toxicity.score(spark.createDataFrame([(1, text.text)], "doc_id long, text string"), model).first()
    assert again.passages and all(0 <= p.start < p.end <= len(text.text.lower().encode()) for p in again.passages)
    edges = toxicity.score(edge_rows(spark), model).collect()
    assert len(edges) == 5 and all(0 <= r.score <= 1 for r in edges) and edges[0].score == edges[1].score
    assert toxicity.drop_toxic(edge_rows(spark), model).columns == ["doc_id", "text", "n"]
    assert toxicity.score(edge_rows(spark).where("doc_id > 9"), model).count() == 0
    nothing = toxicity.fit(docs, labels.where("toxic = 7"))
    assert all(r.score < 1e-9 for r in toxicity.score(edge_rows(spark), nothing).collect())


def scored_ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id long")


def test_quality_held_out(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels, quality.label_grade(), 3)
    assert (np.diff(model["cuts"]) > 0).all()
    graded = quality.grade_documents(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(common.held_out(F.col("doc_id"))).toPandas()
    good = np.array([t[0] >= 0.5 for t in graded["tails"]])
    assert (good == (graded["quality"] == 1)).mean() > 0.9
    assert good[graded["quality"].to_numpy() == 1].mean() > 0.97
    assert all(t[0] >= t[1] for t in graded["tails"]) and graded["expected_grade"].between(0, 2).all()
    assert quality.grade_documents(edge_rows(spark), model).count() == 5
    assert quality.select(edge_rows(spark), model, 1, 0.0).columns == ["doc_id", "text", "n"]
    one_grade = quality.fit(docs, labels.where("quality = 1 and toxic = 0"), quality.label_grade(), 3)
    assert not one_grade["weights"].any()


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    grade = np.searchsorted([-1.0, 0.5, 2.0], 2 * x + rng.logistic(size=3000))
    w, cuts = quality.fit_cumulative(np.arange(3000), np.zeros(3000, int), x, grade, np.ones(3000), 4, size=1, ridge=0.0, steps=1500)
    assert w[0] == pytest.approx(2, abs=0.3) and np.allclose(cuts, [-1, 0.5, 2], atol=0.35)


def test_language_held_out(spark, tables):
    docs, _ = tables
    model = langid.train_on(docs)
    found = langid.predict(docs.select("doc_id", "text", "lang"), model).where(common.held_out(F.col("doc_id"))).toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.98 and found["score"].between(0, 1).all()
    french = docs.where("lang = 'fr' and length(text) > 800").first().text
    english = docs.where("lang = 'en' and length(text) > 800").first().text
    mixed = spark.createDataFrame([(1, french[:800] + "\n" + english[:800])], "doc_id long, text string")
    row = langid.predict(mixed, model).first()
    assert set(row.lang_mix) >= {"en", "fr"} and abs(row.lang_mix["en"] - 0.5) < 0.2
    edges = langid.predict(edge_rows(spark), model).collect()
    assert [r.lang_pred for r in edges[:4]] == ["und"] * 4 and edges[4].lang_pred in model["languages"]
    assert langid.drop_unidentified(edge_rows(spark), model).count() == 1
    assert langid.predict(spark.createDataFrame([(1, "— 。 ¿")], "doc_id long, text string"), model).first().lang_pred == "und"
    untrained = langid.train_on(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(edge_rows(spark), untrained).collect()} == {"und"}
    assert langid.predict(edge_rows(spark).where("doc_id > 9"), model).count() == 0


def test_mixture_proportions():
    like = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.5, 0.5]])
    share, _ = langid.mixture(like, np.ones(4), np.zeros(4, int), 1, np.ones((1, 2), bool), rounds=200)
    assert share[0] == pytest.approx([2 / 3, 1 / 3], abs=1e-6)


def test_texts_without_a_letter_are_undetermined(spark):
    """Combining marks alone, marks after digits or blanks, and modifiers that are no letters."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.train_on(docs)
    for text in ("\u0301\u0302", "\u0903", "12\u0301 \u0302", "\u20dd \u0300!", "", None, "١٢٣"):
        assert langid.infer([text], model) == [("und", 0.0, {})]
    assert langid.letters_only("e\u0301t\u0302\u0302e \u0301 3\u0302") == langid.words.encode("e\u0301t\u0302\u0302e   3 ")
    assert langid.infer(["e\u0301te\u0301"], model)[0][0] != "und"


def test_fit_of_many_words_is_lean_in_the_driver(spark):
    """The driver gets word counts as columns, not as one object for each word."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x:x}q" for x in rng.integers(0, 60_000, 1000))) for k in range(400)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    tracemalloc.start()
    try:
        model = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print("bytes a word", peak / model["words"].size)
    assert model["words"].size > 50_000 and peak < 400 * model["words"].size
