"""Token counts, byte-level BPE and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

from tidemark.llm import bpe, packing, token_counts, vocab  # noqa: E402

RNG = random.Random(11)
PARTS = ["a", "b", " ", "  ", "\n", "\t", "\x00", "▁", "é", "ß", "中", "\U0001f600", "'s", ".", "0", "<s>", "</s>", "<unk>", "<|endoftext|>", "the", "\xa0", "\r\n", "ing", "zz"]
TEXTS = ["".join(RNG.choice(PARTS) for _ in range(RNG.randrange(16))) for _ in range(1500)]
TEXTS += ["", " ", "x" * 5000, "ab" * 3000, "the quick brown fox " * 400, " leading", "trailing  ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
TEXTS += ["".join(RNG.choice("abcdeinorst") for _ in range(RNG.randrange(1, 40))) for _ in range(1500)]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(len(texts), None, "x")], "doc_id long, text string, ids string")


def test_counts_equal_the_library(spark):
    own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, TEXTS)).collect()}
    for k, t in enumerate([*TEXTS, ""]):
        n = len(own.encode(t))
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len(t.encode()), n > 4096), t[:40]


def test_table_may_be_cleared(monkeypatch):
    counts = token_counts._Counts(token_counts.Proof(P.path("piece_bpe_32k.model")))
    monkeypatch.setattr(token_counts, "TABLE_WORDS", 3)
    assert [token_counts.count(t, counts) for t in TEXTS[:300]] == [len(counts.proof.library.encode(t)) for t in TEXTS[:300]]


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocab.ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_encoding_equals_the_library_and_decodes_back(spark):
    own = library()
    got = {r.doc_id: r for r in bpe.encode_digests(frame(spark, TEXTS).drop("ids")).collect()}
    for k, t in enumerate([*TEXTS, ""]):
        ids = own.encode_ordinary(t)
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_replay_with_a_rank_below_its_parents():
    """A pair made by a merge may have a lower rank than that merge; such words are encoded alone."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"bc": 310, b"ab": 320, b"abcabc": 330, b"cd": 340}
    own = tiktoken.Encoding("tiny", pat_str=r"\w+", mergeable_ranks=ranks | {bytes([b]) + b"~": 400 + b for b in range(1)}, special_tokens={})
    replay = bpe.MergeReplay(ranks | {b"\x00~": 400})
    words = ["".join(random.Random(k).choice("abcd") for _ in range(k % 17)) for k in range(400)]
    for w, ids in zip(words, replay.replay([w.encode() for w in words]), strict=True):
        assert ids == (own.encode_ordinary(w) if w else []), w
        assert replay.decode(ids) == w.encode()
    with pytest.raises(ValueError):
        replay.decode([999999])


def test_ids_and_decode_columns(spark):
    rows = bpe.encode(frame(spark, TEXTS[:50]).drop("ids"))
    back = bpe.decode(rows).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == dict(enumerate([*TEXTS[:50], ""]))
    assert bpe.encode(frame(spark, []).where("doc_id > 5").drop("ids")).count() == 0


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = TEXTS[:400] + [" ".join(RNG.choice(["alpha", "beta", "<|endoftext|>", "x1"]) for _ in range(n)) for n in (900, 1023, 1024, 2500, 5000)]
    rows = packing.pack(frame(spark, texts)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate([*texts, ""]):
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by[k], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == ids.size
        assert all(r.length == 1024 for r in mine[1:]) and [r.start for r in mine] == list(np.cumsum([0, *[r.length for r in mine][:-1]]))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024


def counts_of(lengths, capacity):
    return np.bincount(lengths, minlength=capacity + 1)


def best(lengths, capacity):
    """Fewest bins by exhaustive search."""
    lengths = sorted(lengths, reverse=True)
    answer = [len(lengths)]

    def put(k, rooms):
        if len(rooms) >= answer[0]:
            return
        if k == len(lengths):
            answer[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                put(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
        put(k + 1, [*rooms, capacity - lengths[k]])

    put(0, [])
    return answer[0]


def test_plans_are_valid_and_near_the_optimum():
    rng = random.Random(3)
    excess = 0
    for _ in range(40):
        capacity = rng.choice([10, 20, 31])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        found, bound = packing.plan(counts_of(lengths, capacity), capacity)
        used = [n for p, k in found for n in p * k]
        assert sorted(used) == sorted(lengths) and all(sum(p) <= capacity for p, _ in found)
        bins, least = sum(k for _, k in found), best(lengths, capacity)
        assert bound <= least <= bins
        excess += bins - least
    assert excess == 0


def test_plan_of_many_equal_lengths_is_short():
    found, _ = packing.plan(counts_of([1] * 100_000, 1024), 1024)
    assert sum(k for _, k in found) == 98 and len(found) <= 3
    assert packing.plan(np.zeros(1025, int), 1024)[0] == []
