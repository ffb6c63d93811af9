"""The registered queries of the corpus operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, divergence, exact_dedup, langid, media, mixing, ngram_join, packing, quality, resampling, token_counts, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.table(spark, sf_dir, "documents")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, n_passages. Null and empty texts score as without evidence; empty tables give no row."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.cast("int").alias("predicted"), "evidence", F.size("passages").alias("n_passages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links: five-word shingles, Jaccard of 0.8 or more."""
    return ngram_join.near_duplicate_classes(_documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "copies")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. A null text counts as empty; repeated rows count each."""
    return token_counts.token_counts(_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. A null text counts as empty; rows that repeat id and text are kept or not together."""
    return exact_dedup.mark_copies(_documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, sizes and digests of each text stored as an image and read back, its feature and its NPY tile. A null text is an empty one."""
    return media.text_media(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 poor, 1 good but toxic, 2 good: expected grade, tail probabilities, and selection by the first tail."""
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"), quality.label_grade(), 3)
    graded = quality.grade_documents(docs.select("doc_id", "text"), model)
    tails = F.col("tails")
    return graded.select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "expected_grade", tails[0].alias("score"), tails[1].alias("top_grade_probability"), (tails[0] >= 0.5).alias("kept")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. A null text has the end id alone; repeated rows are packed each."""
    return packing.pack(_documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. A null text has no ids; repeated rows are encoded each."""
    return bpe.encode_digests(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to. A null payload is an empty one; repeated rows give a row each."""
    return warc.capture_digests(common.table(spark, sf_dir, "pages"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_set. Texts that are null or have no letter are ``und``; ties go to the first language by name."""
    docs = _documents(spark, sf_dir)
    model = langid.train_on(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.map_keys("lang_mix").alias("lang_set"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of a language's sources and the terms that a source uses more. Null text, lang and source are ''; repeated rows count each."""
    return divergence.audit(_documents(spark, sf_dir))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: whole copies of documents whose words meet their sources' targets. Null texts have size 0; repeated rows are documents each."""
    return mixing.copies(_documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank: documents drawn towards the benchmark's words. Texts without words weigh 0; repeated rows are ranked each."""
    return resampling.importance_ranks(_documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_media": op5_media,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_bpe": op8_bpe,
    "op9_warc": op9_warc,
    "op10_langid": op10_langid,
    "op11_source_divergence": op11_source_divergence,
    "op12_mixing": op12_mixing,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_source_divergence": divergence.ORACLE_SQL,
    "op13_importance_resampling": resampling.ORACLE_SQL,
}
