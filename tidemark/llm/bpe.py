"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A chunk of the corpus (many documents) is cut into pre-tokens by the pattern;
its distinct unseen pre-tokens become one flat array of symbols with links to
left and right neighbours. An inverted index from the rank of a mergeable pair
to the positions where it stands gives all merges of the chunk in rank order:
the lowest rank is replayed at all its positions from left to right, and only
the touched neighbours' pairs are looked up and indexed anew. A word in which
a merge makes a pair of a lower rank than its own is encoded on its own
afterwards, always taking the lowest rank and leftmost pair, since there the
replay's order could differ. A chunk has CHUNK_BYTES of text or one longer text;
a worker keeps the results for words until they take CACHE_BYTES, so words that
several workers or chunks meet after that are replayed in each: the corpus is
replayed by chunks, as an index of it all would not fit into any one task.

Defined cases: a null text encodes as an empty one, without ids; null ids
decode to empty bytes; ids that the vocabulary lacks raise an error; texts of
any length are encoded whole; repeated rows are encoded each; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import common, vocab

#: Bytes (about) of the words and ids that a worker keeps, what an entry takes besides them, and bytes of text replayed together.
CACHE_BYTES, ENTRY_BYTES, CHUNK_BYTES = 192 << 20, 200, 4 << 20


class MergeReplay:
    """Encoder of words (bytes) by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.first = [ranks.get(bytes([b]), -1) for b in range(256)]
        # Rank of every pair of tokens that merges: all ways to cut a token into two.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by replaying all merges of all words in rank order."""
        out: list = [None] * len(words)
        symbol: list[int] = []
        ends: list[tuple[int, int, int]] = []
        ranks, first, rank_of = self.ranks, self.first.__getitem__, self.pairs.get
        for k, word in enumerate(words):
            whole = ranks.get(word)
            if whole is not None:  # as in the library, a word that is a token stays whole
                out[k] = [whole]
                continue
            start = len(symbol)
            symbol += map(first, word)
            symbol.append(-1)  # between words stands a symbol that never merges
            ends.append((k, start, len(symbol) - 1))
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        index: dict[int, list[int]] = {}
        keys = np.array(symbol, np.int64)
        keys = (keys[:-1] << 20 | keys[1:]).tolist() if n else []
        for p, rank in enumerate(map(rank_of, keys)):
            if rank is not None:
                if rank in index:
                    index[rank].append(p)
                else:
                    index[rank] = [p]
        waiting = list(index)
        heapq.heapify(waiting)
        odd: list[int] = []
        while waiting:
            rank = heapq.heappop(waiting)
            places = index.pop(rank)
            places.sort()
            here = rank << 20
            for p in places:
                q = right[p]
                a = symbol[p]
                if a < 0 or rank_of(a << 20 | symbol[q]) != rank:
                    continue  # a neighbour was merged meanwhile
                symbol[p], symbol[q] = rank, -2
                after = right[p] = right[q]
                left[after] = p
                made = rank_of(here | symbol[after])
                if made is not None:
                    if made < rank:
                        odd.append(p)
                    if made in index:
                        index[made].append(p)
                    else:
                        index[made] = [p]
                        heapq.heappush(waiting, made)
                before = left[p]
                if before >= 0 and (a := symbol[before]) >= 0:
                    made = rank_of(a << 20 | rank)
                    if made is not None:
                        if made < rank:
                            odd.append(p)
                        if made in index:
                            index[made].append(before)
                        else:
                            index[made] = [before]
                            heapq.heappush(waiting, made)
        strange = set(np.searchsorted([s for _, s, _ in ends], odd, "right") - 1) if odd else ()
        for at, (k, start, end) in enumerate(ends):
            out[k] = self.alone(words[k]) if at in strange else [s for s in symbol[start:end] if s >= 0]
        return out

    def alone(self, word: bytes) -> list[int]:
        """Ids of one word, merging the lowest rank and leftmost pair each time."""
        symbol = [self.first[b] for b in word]
        n, rank_of = len(symbol), self.pairs.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, p) for p in range(n - 1) if (r := rank_of(symbol[p] << 20 | symbol[p + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, p = heapq.heappop(heap)
            q = right[p]
            if symbol[p] < 0 or q < 0 or rank_of(symbol[p] << 20 | symbol[q]) != rank:
                continue
            symbol[p], symbol[q] = rank, -2
            right[p] = right[q]
            if right[p] >= 0:
                left[right[p]] = p
                if (made := rank_of(rank << 20 | symbol[right[p]])) is not None:
                    heapq.heappush(heap, (made, p))
            if left[p] >= 0 and (made := rank_of(symbol[left[p]] << 20 | rank)) is not None:
                heapq.heappush(heap, (made, left[p]))
        return [s for s in symbol if s >= 0]

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self.bytes_of
        out = []
        for i in ids:
            token = table[i] if 0 <= i < len(table) else b""
            if not token:
                raise ValueError(f"no token has the id {i}")
            out.append(token)
        return b"".join(out)


class Encoder:
    """Encodes chunks of texts; keeps the ids of words met, up to a bound."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.replayer = MergeReplay(vocab.ranks(path))
        self.find = regex.compile(pattern).findall
        self.ids_of: dict[str, bytes] = {}
        self.kept = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        found = [self.find(t) for t in texts]
        if self.kept > CACHE_BYTES:  # also after one chunk of very long words
            self.ids_of, self.kept = {}, 0
        new = list(set().union(*found).difference(self.ids_of))
        for word, ids in zip(new, self.replayer.replay([w.encode() for w in new]), strict=True):
            self.ids_of[word] = made = np.array(ids, "<u4").tobytes()
            self.kept += len(word) + len(made) + ENTRY_BYTES
        get = self.ids_of.__getitem__
        return [b"".join(map(get, ws)) for ws in found]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _chunks(batches):
    """Runs of Arrow batches with about CHUNK_BYTES of text together."""
    run, size = [], 0
    for batch in batches:
        run.append(batch)
        size += batch.columns[-1].nbytes
        if size >= CHUNK_BYTES:
            yield run
            run, size = [], 0
    if run:
        yield run


def _encode(names: list[str], path: str, pattern: str, digest: bool):
    def work(batches):
        own = encoder(path, pattern)
        for run in _chunks(batches):
            texts = [t or "" for b in run for t in b.columns[-1].to_pylist()]
            encoded = own.encode(texts)
            at = 0
            for batch in run:
                mine = encoded[at : at + batch.num_rows]
                at += batch.num_rows
                counts = pa.array([len(x) // 4 for x in mine], pa.int64())
                if digest:
                    back = [own.replayer.decode(np.frombuffer(x, "<u4").tolist()) for x in mine]
                    made = [counts, pa.array([hashlib.sha256(x).hexdigest() for x in mine]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                else:
                    flat = np.frombuffer(b"".join(mine), "<u4").astype(np.int32)
                    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in mine]))).astype(np.int32)
                    made = [counts, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    return work


def encode(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` without the text, with n_tokens long and ids array<int>."""
    return _run(docs, text, path, pattern, False, "n_tokens long, ids array<int>")


def encode_digests(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` without the text, with n_tokens and the SHA-256 of the ids (little-endian 32-bit) and of the bytes decoded from them."""
    return _run(docs, text, path, pattern, True, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _run(docs: DataFrame, text: str, path: str | None, pattern: str | None, digest: bool, made: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    path = path or vocab.default_path("byte_bpe_50k.tiktoken")
    base, schema, finish = common.with_input(docs, text, made, keep=False)
    return finish(base.mapInArrow(_encode(schema.names, path, pattern or vocab.default_pattern(), digest), schema))


def decode(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``rows`` with the bytes that the ids (array<int>) stand for."""
    common.small_batches(rows.sparkSession)
    path = path or vocab.default_path("byte_bpe_50k.tiktoken")

    base, schema, finish = common.with_input(rows, ids, f"`{out}` binary")

    def work(batches):
        replayer = MergeReplay(vocab.ranks(path))
        for batch in batches:
            made = pa.array([replayer.decode(v or ()) for v in batch.columns[-1].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], schema.names)

    return finish(base.mapInArrow(work, schema))
