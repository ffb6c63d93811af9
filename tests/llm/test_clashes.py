"""Extra columns with the operators' own names, odd names and nulls in every column."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, exact_dedup, langid, media, ngram_join, packing, quality, token_counts, toxicity

SF = "/root/testdata/sf0.001"
NAMES = ["score", "lang_pred", "maybe", "c1", "cell", "_bucket0", "row_key", "text_sha256", "n_tokens", "ids", "fp", "band", "tails", "piece", "length", "odd `name.x", "_row2", "feature", "salt", "keep_id"]


@pytest.fixture(scope="module")
def docs(spark):
    base = common.table(spark, SF, "documents")
    nulls = spark.createDataFrame([(None,) * 5] * 2, base.schema)
    out = base.unionByName(nulls)
    for n in NAMES:
        out = out.withColumn(n, F.when(F.col("doc_id") % 2 == 0, F.lit("v")))
    return out.persist()


def test_stages_keep_all_columns(spark, docs):
    labels = common.table(spark, SF, "labels").unionByName(spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int"))
    stages = [
        lambda d: langid.drop_unidentified(d, langid.train_on(d)), lambda d: toxicity.drop_toxic(d, toxicity.fit(d, labels)), exact_dedup.drop_copies, ngram_join.drop_near_duplicates,
        lambda d: quality.select(d, quality.fit(d, labels, quality.label_grade(), 3), 1, 0.5),
    ]
    for stage in stages:
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r["score"] == ("v" if r.doc_id is not None and r.doc_id % 2 == 0 else None) for r in rows)


def test_made_columns_replace_their_namesakes(spark, docs):
    model = langid.train_on(docs)
    assert dict(langid.predict(docs, model).dtypes)["score"] == "double"
    assert dict(bpe.encode(docs).dtypes)["ids"] == "array<int>"
    assert {r.n_tokens is None for r in bpe.encode(docs).select("n_tokens").collect()} == {False}
    for made in (exact_dedup.mark_copies(docs), ngram_join.near_duplicate_classes(docs), token_counts.token_counts(docs), media.text_media(docs)):
        assert made.count() == docs.count()
    assert packing.pack(docs).select("doc_id", "piece").where("piece = 0").count() == docs.count()
