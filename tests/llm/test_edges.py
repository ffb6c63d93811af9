"""Empty tables, nulls, repeated rows, clashing names, very long texts and bounds in bytes, for operators and the pipeline."""

import sys

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, exact_dedup, langid, media, ngram_join, packing, quality, queries, token_counts, toxicity, vocab, warc

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "pages", "benchmark"):
        common.table(spark, SF, name).limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_of_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_pipeline_of_empty_tables(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    odd = spark.createDataFrame(
        [(90001, None, None, None, None), (90002, "", "en", "s", 0), (None, "one two three four five six seven", "en", None, 3), (90003, "one two three four five six seven", None, "s", 3), (90003, "one two three four five six seven", None, "s", 3)],
        docs.schema,
    )
    names = {"score": F.lit("a"), "lang_pred": F.lit("b"), "fp": F.lit("c"), "hash": F.lit("d"), "band": F.lit("e"), "cell": F.lit(1), "_row": F.lit(2)}
    whole = docs.unionByName(odd).unionByName(docs.limit(20)).withColumns(names)
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    rows = common.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.written(stage(spark, rows, str(tmp_path)), name)
        assert rows.columns == whole.columns
    kept = [r.doc_id for r in rows.collect()]
    assert len([k for k in kept if k is not None]) == len({k for k in kept if k is not None}) and not {90001, 90002} & set(kept)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept)


def test_quality_of_unknown_ids_and_bytes(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    strangers = labels.withColumn("doc_id", F.col("doc_id") + 10**9)
    model = quality.fit(docs, strangers, quality.label_grade(), 3)
    assert not model["weights"].any() and quality.grade_documents(docs, model).count() == docs.count()
    assert not quality.fit(docs, labels, quality.label_grade(), 3, fit_bytes=10)["weights"].any()
    small = quality.fit(docs, labels, quality.label_grade(), 3, fit_bytes=200_000)
    assert small["weights"].any()


def test_samples_stay_within_their_bytes(spark):
    rows = spark.createDataFrame([("a", k, "x" * (1000 * (k % 3))) for k in range(30)] + [("b", 1, "y" * 5000), ("b", 2, None)], "g string, k int, t string")
    got = common.within_bytes(rows, "t", "g", "k", 4200).collect()
    assert sorted(r.k for r in got if r.g == "a") == [0, 1, 2, 3] and [r.k for r in got if r.g == "b"] == [2]
    assert common.within_bytes(rows.where("k > 99"), "t", "g", "k", 10).count() == 0


def test_toxicity_sample_bytes_and_ties(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    nothing = toxicity.fit(docs, labels, fit_bytes=10)
    assert not nothing["words"].size and all(r.score < 1e-9 for r in toxicity.score(docs.limit(5), nothing).collect())
    doubled = toxicity.fit(docs, labels.unionByName(labels))  # repeated ratings, equal hashes
    plain = toxicity.fit(docs, labels)
    assert doubled["curve"] == pytest.approx(plain["curve"]) and (doubled["words"] == plain["words"]).all()


def test_long_texts_without_spaces(spark):
    long = "é你" * 400_000 + "x" * 1_500_000
    rows = spark.createDataFrame([(1, long), (2, "a b"), (3, long)], "doc_id long, text string")
    counted = {r.doc_id: r for r in token_counts.token_counts(rows).collect()}
    assert counted[1].n_bytes == len(long.encode()) and counted[1].n_tokens == counted[3].n_tokens > 4096
    table = token_counts._Counts(token_counts.Proof(vocab.default_path("piece_bpe_32k.model")))
    token_counts.count("q" * 5000 + " short", table)
    assert "short" in table and max(map(len, table)) <= max(token_counts.KEPT_LETTERS, max(map(len, table.fixed)))
    classes = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicate_classes(rows).collect()}
    assert classes == {1: (1, 1), 2: (2, 0), 3: (1, 1)}
    encoded = {r.doc_id: r for r in bpe.encode_digests(rows.where("doc_id < 3")).collect()}
    assert encoded[1].n_tokens > 0
    found = {r.doc_id: r.lang_pred for r in langid.predict(rows, langid.train_on(common.table(spark, SF, "documents"))).collect()}
    assert set(found) == {1, 2, 3} and found[1] == found[3]


def test_bpe_forgets_words_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    own = bpe.Encoder(vocab.default_path("byte_bpe_50k.tiktoken"), vocab.default_pattern())
    texts = [" ".join(f"w{k}{j}" for j in range(30)) for k in range(20)] + ["z" * 100_000]
    once = [own.encode([t])[0] for t in texts]
    assert own.kept > 2000 and own.encode(texts[:1]) == once[:1] and len(own.ids_of) < 100


def test_repeated_rows_encode_each(spark):
    rows = spark.createDataFrame([(1, "a b", "n"), (1, "a b", "n"), (None, None, None)], "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id, r.n_tokens) for r in bpe.encode_digests(rows).collect()), key=str)
    assert got == [(1, 2), (1, 2), (None, 0)]
    assert sorted(r.n_tokens for r in token_counts.token_counts(rows).collect()) == [0, 2, 2]


def test_large_payloads_stand_in_archives_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", "x" * (50 if k % 2 else 400) + str(k // 4)) for k in range(16)], "page_id long, url string, html string").coalesce(1)
    rows, largest = warc.with_revisits(pages)
    assert largest > 400
    warc.write(rows, f"{tmp_path}/w", large=100, largest=largest)
    found = warc.read(spark, f"{tmp_path}/w")
    assert found.count() == 48 and warc.assemble(found).count() == 16
    large = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/w/large").where("length > 100").count()
    assert large >= 8


def test_a_revisit_that_differs_from_its_response_raises(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "v", "same")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.capture_digests(pages).collect()} == {"response", "revisit"}
    whole = warc.base32_digest
    monkeypatch.setattr(warc, "base32_digest", lambda c: F.concat(F.lit("A"), whole(c)))
    with pytest.raises(Exception, match="differs from the response"):
        warc.capture_digests(pages).collect()


def test_marks_scan_the_texts_once(spark):
    docs = spark.createDataFrame([(k, f"t{k % 7}") for k in range(50)], "doc_id long, text string")
    plan = exact_dedup.mark_copies(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" not in plan and "xxhash64(text" not in plan  # both passes read the written hashes


def test_payload_tile_is_npy(spark):
    row = media.text_media(spark.createDataFrame([(1, "hello")], "doc_id long, text string")).first()
    assert media.read_tile(bytes(row.tile_npy)).shape[:2] == (media.TILE, media.TILE)


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())


def test_written_tables_can_be_dropped(spark):
    import os

    df, facts = common.measured(spark.range(7), "gone", n=F.count(F.lit(1)), top=F.max("id"))
    path = df._written_to.removeprefix("file://").removeprefix("file:")
    assert facts == {"n": 7, "top": 6} and os.path.isdir(path)
    common.drop(df)
    assert not os.path.exists(path)
    common.drop(df, spark.range(3))
    assert common.measured(spark.range(0), "none", n=F.count(F.lit(1)), top=F.max("id"))[1] == {"n": 0, "top": 0}
