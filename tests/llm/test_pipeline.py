"""The corpus pipeline against brute force over its own stages' inputs."""

import re
import sys
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.llm import common, langid, toxicity

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def shingles(text):
    found = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_stages_decide_as_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.columns == names
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    languages = common.table(spark, SF, "documents").count()
    assert len(kept["language_id"]) == languages  # all documents of this table have letters
    toxic = {r.doc_id for r in common.table(spark, SF, "labels").where("toxic = 1").collect()}
    labelled = {r.doc_id for r in common.table(spark, SF, "labels").collect()}
    gone = set(kept["language_id"]) - set(kept["toxicity"])
    assert len(gone & (labelled - toxic)) <= 0.06 * len(labelled - toxic)
    best = {}
    for i, t in kept["toxicity"].items():
        best[t] = max(i, best.get(t, i))
    assert set(kept["exact_dedup"]) == set(best.values())
    texts = kept["exact_dedup"]
    sets, group = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    assert set(kept["ngram_jaccard_join"]) == {min(k for k in group if group[k] == g) for g in set(group.values())}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept["ngram_jaccard_join"])


def test_language_and_toxicity_stages_drop_what_their_models_say(spark):
    """Rows that have to go: no letters, no leading language, toxic scores; and none besides."""
    docs = common.table(spark, SF, "documents")
    known = docs.collect()
    by = {}
    for r in known:
        by.setdefault(r.lang, []).append(r.text)
    cut = lambda t, n: " ".join(t.split()[:n])
    mixed = [" ".join(cut(by[k][j], 60) for k in sorted(by)) for j in range(3)]
    odd = [(90001, None), (90002, ""), (90003, "12 34 !! \u0301"), *[(90010 + j, t) for j, t in enumerate(mixed)], (90020, " ".join(by["fr"][:3] * 400)), (None, None), (None, None)]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    whole = docs.unionByName(extra)
    kept = common.written(corpus_pipeline.language_id(spark, whole, SF), "stage").collect()
    model = langid.train_on(docs)
    stays = [(i, t) for i, t in [*((r.doc_id, r.text) for r in known), *odd] if (m := langid.infer([t], model)[0])[0] != "und" and m[1] >= langid.LEADING]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(stays, key=str)
    gone = {i for i, _ in odd} - {r.doc_id for r in kept}
    assert {None, 90001, 90002, 90003} <= gone and gone & {90010, 90011, 90012} and 90020 not in gone

    clean = common.written(corpus_pipeline.toxicity_filter(spark, whole, SF), "stage").collect()
    fitted = toxicity.fit(docs, common.table(spark, SF, "labels"))
    scorer = toxicity.Scorer(fitted)
    score = lambda t: scorer.probability(next(scorer.passages([t]))[2])
    stays = [(i, t) for i, t in [*((r.doc_id, r.text) for r in known), *odd] if score(t) < toxicity.THRESHOLD]
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted(stays, key=str)
    toxic = {r.doc_id for r in common.table(spark, SF, "labels").where("toxic = 1").collect()}
    assert toxic - {i for i, _ in stays}  # this table has a dozen toxic texts to learn from; its recall is tested on larger ones


def test_long_and_repeated_rows_run_through_all_stages(spark):
    docs = common.table(spark, SF, "documents")
    long = " ".join(f"wort{k % 977} und haus{k % 31}" for k in range(60_000))
    rows = [(91001, long, "de", "s", len(long)), (91002, long, "de", "s", len(long)), (91003, "x", None, None, None), *[(None, None, None, None, None)] * 3, *[(91004, "ein haus und noch ein haus", None, "s", 1)] * 4]
    frame = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({c: F.lit("theirs") for c in ("sequence_id", "score", "kept", "row_key")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.written(stage(spark, frame, SF), name)
        assert {"sequence_id", "score", "kept", "row_key"} < set(frame.columns)
    left = {r.doc_id: r["count"] for r in frame.groupBy("doc_id").count().collect()}
    assert left.get(91002) == 1 and 91001 not in left and left.get(91004) == 1 and None not in left
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert packed.where("doc_id = 91002").agg(F.sum("length")).first()[0] > 60_000 and {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)


def test_run_and_stage_list(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "ngram_jaccard_join", "best_fit_packing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
