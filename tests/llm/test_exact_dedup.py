"""Exact dedup against brute force."""

import hashlib

import pytest

from tidemark.llm import common, exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        g = groups[t or ""]
        out.append((i, max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é\U0001f600" * 9000), (6, "b"), (9, "a"), (8, " a"), (7, "A"), (10, "é\U0001f600" * 9000)]


@pytest.mark.parametrize("bits_per_row", [1, 16])
def test_marks_equal_brute_force(spark, bits_per_row, monkeypatch):
    if bits_per_row == 1:  # a saturated filter sends every row to the comparison and changes nothing
        monkeypatch.setattr(common, "filter_bits", lambda rows, bits=16: 2)
    rows = ROWS + [(100 + k, f"text {k % 40}") for k in range(200)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, keep_id string")
    assert sorted(tuple(r) for r in exact_dedup.mark_copies(docs).collect()) == brute(rows)


def test_dropping_keeps_columns_and_one_row(spark):
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in ROWS], "doc_id long, text string, cell string")
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.cell) for r in left.collect()) == sorted((i, f"s{i}") for i, keep, _, kept, _ in brute(ROWS) if kept)


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "a"), (None, "q"), (None, "q")], "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(docs).collect()), key=str)
    assert left == [(3, "a"), (None, "q")]
    marks = exact_dedup.mark_copies(docs).where("text_sha256 = sha2('a', 256)").collect()
    assert sorted(r.kept for r in marks) == [False, False, True, True] and all(r.group_size == 4 for r in marks)
    assert exact_dedup.mark_copies(docs.where("doc_id > 5")).count() == 0 and exact_dedup.drop_copies(docs.where("doc_id > 5")).count() == 0


def test_normalisation_and_plan(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string")
    from pyspark.sql import functions as F

    marks = exact_dedup.mark_copies(docs, normalise=F.lower)
    assert {r.keep_id for r in marks.collect()} == {2}
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
