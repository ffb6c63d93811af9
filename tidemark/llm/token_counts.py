"""Token counts of a SentencePiece BPE vocabulary by whole-token shortcut.

Offline, from the vocabulary alone, it is proved where texts can be cut and
which strings are one token:
- the model's normaliser is the identity but for one mark for each space and one
  put before the text, so a text's characters are those that are merged;
- no piece holds a space mark after another character, so no merge crosses the
  place before a space mark: a text is counted as the sum of its pre-tokens,
  each a run of space marks and the characters up to the next (``Proof`` reads
  both from the model and its every piece, and refuses where one fails);
- pieces that the library encodes alone as exactly themselves form the set of
  whole tokens: equal pre-tokens count one, without any merging.
Only other pre-tokens are merged, by the library itself on that pre-token, and
those of KEPT_LETTERS or less once for a worker's table, which is cleared at
TABLE_WORDS; both bound its bytes, and text without spaces is never kept.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); NUL and
special strings are ordinary text, as in the library; a pre-token of any length
is counted whole; repeated rows are counted each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, vocab

SPACE = "▁"
TABLE_WORDS, KEPT_LETTERS = 300_000, 64


class Proof:
    """What holds for a vocabulary: cuts before space marks, and its whole tokens."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rules = model.normalizer_spec
        kept = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if not kept or rules.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this vocabulary changes characters or white space; its texts cannot be cut at spaces")
        if any(p.type == model.SentencePiece.USER_DEFINED for p in model.pieces):
            raise ValueError("this vocabulary has strings that are cut out before merging; its texts cannot be cut at spaces")
        size = self.library.get_piece_size()
        plain = [
            i for i in range(size)
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))
        ]
        pieces = [self.library.id_to_piece(i) for i in plain]
        crossing = [p for p in pieces if SPACE in p.lstrip(SPACE) or " " in p]
        if crossing:
            raise ValueError(f"pieces cross a space mark, so texts cannot be cut there: {crossing[:3]}")
        # A pre-token with a mark is encoded by the library from the text after that mark.
        marked = [p for p in pieces if p[0] == SPACE and len(p) > 1]
        self.whole = {p for p, ids in zip(marked, self.library.encode([p[1:] for p in marked], num_threads=1), strict=True) if len(ids) == 1 and self.library.id_to_piece(ids[0]) == p}

    def merged(self, pre_token: str) -> int:
        return len(self.library.encode(pre_token[1:]))

    def marks(self, n: int) -> int:
        """Tokens of n space marks after which nothing comes; they are cut off what stands before them."""
        return len(self.library.encode("a" + " " * n)) - len(self.library.encode("a"))


class _Counts(dict):
    """Tokens of a word that follows one space, without that space."""

    def __init__(self, proof: Proof):
        super().__init__()
        self.proof, self.fixed = proof, {p[1:]: 1 for p in proof.whole}
        self.update(self.fixed)

    def __missing__(self, word: str) -> int:
        n = self.proof.merged(SPACE + word)
        if len(word) <= KEPT_LETTERS:
            if len(self) > len(self.fixed) + TABLE_WORDS:
                self.clear()
                self.update(self.fixed)
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _counts(path: str) -> _Counts:
    return _Counts(Proof(path))


def count(text: str, counts: _Counts) -> int:
    """Tokens of a text."""
    if not text:
        return 0
    if SPACE in text:  # to the library the mark is a space
        text = text.replace(SPACE, " ")
    words = text.split(" ")  # the mark put before the text makes the first word like the others
    if "" not in words:
        return sum(map(counts.__getitem__, words))
    total, spaces = 0, 0
    for word in words:
        if not word:
            spaces += 1
            continue
        total += counts[word] if not spaces else counts[" " * spaces + word]
        spaces = 0
    if spaces:  # a run of marks at the end of the text
        total += counts.proof.marks(spaces)
    return total


def _counter(path: str):
    def work(batches):
        counts = _counts(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            n = pa.array([count(t or "", counts) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("n_bytes")), n], ["doc_id", "n_bytes", "n_tokens"])

    return work


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row; null ids stay null."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_counter(path or vocab.default_path("piece_bpe_32k.model")), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
