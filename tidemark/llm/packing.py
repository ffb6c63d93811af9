"""Best-fit packing of token sequences by bin completion with branch and bound.

1. Each text becomes ids and an end id; longer documents are cut into pieces
   of the capacity, the first of which may be shorter.
2. Only piece lengths matter to the packing, and there are at most as many
   lengths as the capacity: the pieces are counted by length (a bounded table).
3. The plan is found on that histogram by bin completion. Around the largest
   open length, all undominated fillings of the room left are enumerated, least
   waste first, and each is applied as often as the counts allow, then one time
   fewer, down to once. Depth-first search keeps the best plan so far, starting
   from a best-fit decreasing one; every LOOK nodes the rest is packed by best fit
   too. A branch is cut when its waste so far, or the L2 bound of its rest, leaves
   no better plan. The search ends when a plan meets the lower bound, when all
   branches are searched (the plan is then optimal), or after ``steps`` steps,
   with the best plan so far. Its effort depends on the capacity and the steps,
   not on the number of documents.
4. Pieces are ranked within their length (salted, so that a common length is
   dealt to many tasks) and take their places in the plan by rank.

Defined cases: a null text is an empty one, whose ids are the end id alone;
repeated rows are packed each; null ids stay null; a document of exactly the
capacity is one piece; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common, vocab

CAPACITY, END_ID = 1024, 2
#: Steps of the search at most (one for each length tried in a filling without waste, four in one with waste), every how many nodes the rest is packed by best fit, and fillings that an order sorts.
STEPS, LOOK, AHEAD = 800_000, 32, 8
#: Orders of fillings of equal waste: as enumerated; lengths near a quarter of the capacity first, which fit least with each other; abundant ones; even ones.
ORDERS = {
    "enumerated": None,
    "quarters": lambda f, left, capacity: (len(f), min((abs(4 * n - capacity) for n in f), default=0)),
    "abundant": lambda f, left, capacity: (len(f), -min((left[n] // f.count(n) for n in f), default=0)),
    "even": lambda f, left, capacity: (len(f), max(f, default=0)),
}
PIECES = "piece int, start long, length long, ids_crc32 long"


# --- tokens -----------------------------------------------------------------


@lru_cache(maxsize=2)
def fast_encoder(path: str):
    """A function text -> uint32 ids equal to those of the tokenizers file, without special tokens added.

    A byte-level file whose merges are in the order of their ids gives the same
    ids as its ranks do; those are encoded several times faster. Any other file is
    encoded by its own library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocabulary = model.get("vocab") or {}
    to_byte = {c: b for b, c in _byte_letters().items()}
    plain = (
        model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    )
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = plain and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    if plain:
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" ", 1))] for m in model["merges"]]
        plain = made == sorted(made)
    if plain:
        import tiktoken

        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        core = tiktoken.Encoding("own", pat_str=vocab.default_pattern(), mergeable_ranks=ranks, special_tokens=special)._core_bpe
        allowed = set(special)
        return lambda text: np.frombuffer(core.encode_to_tiktoken_buffer(text, allowed), np.uint32)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level files: printable Latin-1 as itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of the capacity but the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    common.small_batches(docs.sparkSession)
    path = path or vocab.default_path("byte_bpe_50k.json")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def work(batches):
        encode = fast_encoder(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate((encode(t or ""), end)).astype("<u4", copy=False)
                for i, (s, n) in enumerate(cuts(ids.size, capacity)):
                    source.append(k)
                    piece.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n]))
            made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int32())), *made], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")


# --- the plan ---------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The L2 bound (which is at least the volume over the capacity)."""
    lengths = np.arange(counts.size)
    number, volume = np.cumsum(counts), np.cumsum(counts * lengths)
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    for k in range(half + 1):
        huge = int(number[-1] - number[capacity - k])
        big = int(number[capacity - k] - number[half])
        room = big * capacity - int(volume[capacity - k] - volume[half])
        small = int(volume[half] - (volume[k - 1] if k else 0))
        best = max(best, huge + big + max(0, -(-(small - room) // capacity)))
    return best


def _spread(bits: int, by: int) -> int:
    """The bits and all their shifts by up to ``by``."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits << step
        done += step
    return bits


class Effort:
    """Steps of the search that are left; when none is, enumerations end."""

    def __init__(self, steps: int):
        self.left = steps

    def spent(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left < 0


def fillings(counts: list[int], room: int, least: int = 0, effort: Effort | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of the room, of a total of ``least`` or more, with the lengths at hand; least waste first.

    ``counts[n]``: pieces of length n, to be as they were whenever the next
    filling is asked for. A filling is dominated if some of its lengths (or
    none) can be exchanged for one length that is left over and longer than they
    are together by no more than the waste. Lengths are tried in descending
    order, so a length above the next one that is left over stays so, and an
    exchange for it cuts the enumeration at once.
    """
    effort = effort or Effort(1 << 62)
    if 0 < room < len(counts) and counts[room]:
        yield (room,)  # dominates all others
        return
    sizes = [n for n in range(min(room, len(counts) - 1), 0, -1) if counts[n]]
    if effort.spent(1 + len(sizes) // 8):
        return
    mask = (1 << (room + 1)) - 1
    # sums[i]: the totals that the lengths from sizes[i] on can give, as bits.
    sums = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        n, bits = sizes[i], sums[i + 1]
        k, step = min(counts[n], room // n), 1
        while k > 0:
            bits |= bits << n * min(step, k) & mask
            k -= step
            step *= 2
        sums[i] = bits
    # from_length[t]: the first index whose length is t or less.
    from_length, i = [0] * (room + 1), len(sizes)
    for t in range(room + 1):
        while i and sizes[i - 1] <= t:
            i -= 1
        from_length[t] = i

    def exchangeable(single: int, multi: int, free: int, waste: int) -> bool:
        """Whether the sum of several chosen lengths, or a single one or none, can be exchanged for a free length."""
        if multi & free:
            return True
        return waste > 0 and bool((_spread(multi, waste) | _spread(single | 1, waste - 1) << 1) & free)

    def exact(first: int, left: int, chosen: tuple[int, ...], single: int, multi: int, free: int, waste: int) -> Iterator[tuple[int, ...]]:
        if not left:
            if not exchangeable(single, multi, free, waste):
                yield chosen
            return
        for j in range(max(first, from_length[left]), len(sizes)):
            if not sums[j] >> left & 1:
                return  # these and shorter lengths cannot give this total
            n = sizes[j]
            one, several, made = single | 1 << n, multi, []
            effort.spent(4 if waste else 1)
            for k in range(1, min(counts[n], left // n) + 1):
                several |= (one if k > 1 else single) << n & mask | several << n & mask
                unused = free & ~(1 << n) if k == counts[n] else free
                made.append((several, unused))
                if exchangeable(one, several, unused >> n + 1 << n + 1, waste):
                    break  # and so it is with more of them
            for k in range(len(made), 0, -1):
                several, unused = made[k - 1]
                if not sums[j + 1] >> left - n * k & 1:
                    continue
                if effort.spent(4 if waste else 1):
                    return
                if not exchangeable(one, several, unused >> n << n, waste):
                    yield from exact(j + 1, left - n * k, chosen + (n,) * k, one, several, unused, waste)

    at_hand = sum(1 << n for n in sizes)
    for total in range(room, max(0, least) - 1, -1):
        if sums[0] >> total & 1:
            yield from exact(0, total, (), 0, 0, at_hand, room - total)
            if effort.left < 0:
                return


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: (lengths, bins) groups."""
    groups: dict[tuple[int, ...], int] = {}
    by_room: list[set] = [set() for _ in range(capacity + 1)]
    rooms = 0  # the rooms of open bins as bits
    for x in range(counts.size - 1, 0, -1):
        n = int(counts[x])
        while n:
            wide = rooms >> x
            if not wide:  # new bins, each filled with this length as far as it goes
                each = min(n, capacity // x)
                made, some = (x,) * each, n // each
                groups[made] = groups.get(made, 0) + some
                by_room[capacity - x * each].add(made)
                rooms |= 1 << capacity - x * each
                n -= some * each
                continue
            room = x + (wide & -wide).bit_length() - 1  # the least that is wide enough
            source = min(by_room[room])
            some = min(n, groups[source])
            groups[source] -= some
            if not groups[source]:
                del groups[source]
                by_room[room].discard(source)
                if not by_room[room]:
                    rooms ^= 1 << room
            made = (*source, x)
            groups[made] = groups.get(made, 0) + some
            by_room[room - x].add(made)
            rooms |= 1 << room - x
            n -= some
    return list(groups.items())


def plan(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """((lengths of a bin, number of such bins) ..., lower bound). ``counts[n]``: pieces of length n.

    A branch fills the bin of the largest open length, and as many more of its
    kind as said: the most that the counts allow, then one fewer, down to one.
    Further bins of that length then take other fillings, so no plan is met twice
    that way and none is lost. A branch ends when the waste so far leaves no
    plan better than the best known. The search is made in each of ORDERS, which
    sort the next few fillings of equal waste, with an equal share of the steps,
    until one meets the bound or has searched all.
    """
    bound = lower_bound(np.asarray(counts, np.int64), capacity)
    best = best_fit(np.asarray(counts, np.int64), capacity)
    incumbent = sum(n for _, n in best)
    left = [int(n) for n in counts]
    volume = sum(n * k for n, k in enumerate(left))
    chain: list[tuple[tuple[int, ...], int]] = []
    used, seen = 0, 0
    effort, order = Effort(0), next(iter(ORDERS.values()))

    def better(rest: list[tuple[tuple[int, ...], int]]) -> None:
        nonlocal best, incumbent
        bins = used + sum(n for _, n in rest)
        if bins < incumbent:
            best, incumbent = [*chain, *rest], bins

    def branches(largest: int, banned: frozenset) -> Iterator[tuple[tuple[int, ...], int, frozenset]]:
        """(lengths of a bin, bins, what other bins of the largest length are not filled with)."""
        left[largest] -= 1
        slack = (incumbent - 1 - used) * capacity - volume
        options = fillings(left, capacity - largest, capacity - largest - slack, effort)
        while True:
            some = sorted(islice(options, AHEAD if order else 1), key=lambda f: (-sum(f), order(f, left, capacity) if order else 0))
            left[largest] += 1
            for filling in some:
                if filling in banned:
                    continue
                banned = banned | {filling}
                lengths = (largest, *filling)
                for times in range(min(left[n] // lengths.count(n) for n in set(lengths)), 0, -1):
                    yield lengths, times, banned
            if not some:
                return
            left[largest] -= 1

    def put(lengths: tuple[int, ...], times: int) -> None:
        nonlocal used, volume
        for n in lengths:
            left[n] -= times
        used += times
        volume -= sum(lengths) * times

    def node(last: int, banned: frozenset) -> Iterator | None:
        """The branches of the counts as they are, without lengths above ``last``; None where they can give nothing better."""
        nonlocal seen
        seen += 1
        effort.spent(2)
        largest = next((n for n in range(last, 0, -1) if left[n]), 0)
        if not largest:
            better([])
            return None
        if used + -(-volume // capacity) >= incumbent:
            return None
        if seen % LOOK == 0:
            effort.spent(LOOK * 4)
            rest = np.array(left)
            if used + lower_bound(rest, capacity) >= incumbent:
                return None
            better(best_fit(rest, capacity))
        return branches(largest, banned if last == largest else frozenset())

    for order in ORDERS.values():
        effort = Effort(steps // len(ORDERS))
        stack = [node(capacity, frozenset())]
        while stack and incumbent > bound and effort.left >= 0:
            branch = next(stack[-1], None) if stack[-1] else None
            if branch is None:
                stack.pop()
                if stack:
                    lengths, times = chain.pop()
                    put(lengths, -times)
                continue
            lengths, times, banned = branch
            put(lengths, times)
            chain.append((lengths, times))
            stack.append(node(lengths[0], banned))
        if not stack or incumbent <= bound:
            break
        while chain:
            lengths, times = chain.pop()
            put(lengths, -times)
    return best, bound


# --- places -----------------------------------------------------------------


def pack_pieces(made: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), which must be cheap to read twice."""
    spark = made.sparkSession
    histogram = made.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    rows, at, base = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, bins in plan(counts, capacity, steps)[0]:
        offset = 0
        for n in lengths:
            rows.append((int(n), int(at[n]), int(at[n]) + bins, base, offset))
            at[n] += bins
            offset += n
        base += bins
    table = spark.createDataFrame(rows, "p_length long, p_from long, p_to long, p_sequence long, offset long")
    salted = made.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(common.salts_for(int(counts.sum())))).cast("int"))
    inner = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(inner).cast("long") - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    # The plan has rows by length and not by document: its size is bounded by the capacity.
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("p_sequence") + F.col("rank") - F.col("p_from")).alias("sequence_id"), "offset"
    )


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, steps: int = STEPS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(common.written(pieces(docs, text, doc_id, capacity, end_id, path), "pieces"), capacity, steps)
