"""Bin completion against exhaustive search, and the edge cases of packing."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import packing


def optimum(lengths, capacity):
    """Fewest bins: the least number into which exhaustive search puts all lengths."""
    lengths = sorted(lengths, reverse=True)
    bins = -(-sum(lengths) // capacity)

    def put(k, rooms):
        if k == len(lengths):
            return True
        tried = set()
        for i, room in enumerate(rooms):
            if room >= lengths[k] and room not in tried:
                tried.add(room)
                rooms[i] -= lengths[k]
                if put(k + 1, rooms):
                    return True
                rooms[i] += lengths[k]
        return False

    while not put(0, [capacity] * bins):
        bins += 1
    return bins


def bins_of(lengths, capacity):
    found, bound = packing.plan(np.bincount(lengths, minlength=capacity + 1), capacity)
    assert sorted(n for p, k in found for n in p * k) == sorted(lengths) and all(sum(p) <= capacity and k > 0 for p, k in found)
    bins = sum(k for _, k in found)
    assert bins >= bound
    return bins


def dominates(a, b):
    """Whether the lengths of b can be grouped so that each group fits into a length of a of its own."""
    rooms, items = sorted(a, reverse=True), sorted(b, reverse=True)

    def put(k):
        if k == len(items):
            return True
        for i in range(len(rooms)):
            if rooms[i] >= items[k]:
                rooms[i] -= items[k]
                if put(k + 1):
                    return True
                rooms[i] += items[k]
        return False

    return put(0)


def test_plans_equal_exhaustive_search():
    rng = random.Random(11)
    for _ in range(2000):
        capacity = rng.randint(10, 60)
        low, high = rng.choice([(1, capacity), (2, capacity // 2), (capacity // 6 + 1, capacity // 2 + 1), (capacity // 5, capacity)])
        lengths = [rng.randint(max(1, low), max(1, high)) for _ in range(rng.randint(8, 13))]
        assert bins_of(lengths, capacity) == optimum(lengths, capacity), (lengths, capacity)


@pytest.mark.parametrize(
    ("capacity", "lengths", "bins"), [(45, [10, 11, 12, 16, 19, 20, 21, 23], 3), (26, [5, 5, 5, 6, 7, 8, 8, 8, 8, 8, 10, 11, 14], 4), (7, [], 0), (7, [7, 7], 2), (1024, [1] * 5000, 5)]
)
def test_plans_of_hard_and_plain_cases(capacity, lengths, bins):
    assert bins_of(np.array(lengths, int), capacity) == bins


def test_fillings_are_all_that_nothing_dominates():
    rng = random.Random(12)
    for _ in range(600):
        lengths = [rng.randint(1, rng.choice([6, 15, 30])) for _ in range(rng.randint(0, 8))]
        room = rng.randint(1, 30)
        subsets = {tuple(sorted(s, reverse=True)) for r in range(len(lengths) + 1) for s in itertools.combinations(lengths, r) if sum(s) <= room}
        want = {f for f in subsets if not any(g != f and dominates(g, f) for g in subsets)}
        got = list(packing.fillings(np.bincount(np.array(lengths, int), minlength=31).tolist(), room))
        assert len(got) == len(set(got)) and set(got) == want, (lengths, room)
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_search_ends_when_its_steps_are_spent():
    rng = random.Random(13)
    lengths = [rng.randint(5, 70) for _ in range(80)]
    found, bound = packing.plan(np.bincount(lengths, minlength=101), 100, steps=50)
    assert sorted(n for p, k in found for n in p * k) == sorted(lengths) and sum(k for _, k in found) >= bound


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (None, None), (2, "word " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert sum(r.doc_id is None for r in got) == 3 and sum(r.doc_id == 1 for r in got) == 2
    assert {(r.sequence_id, r.offset) for r in got} and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack(docs.where("doc_id > 5")).count() == 0
