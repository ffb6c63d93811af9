"""Source divergence audit: how the sources of a language differ in their terms.

Every group (language, source) and every language gives each of the language's V
kept terms p = 1 + floor(10^9 (count + 2) / (N + 2 V)); the divergence of two of
them at a term is f = floor((p - q)^2 / (p + q)). Most counts are zero, so a
pair of groups is not summed over V terms:

1. One pass over the whole texts counts terms by group, added up in each task
   before they meet. Terms in ``least_docs`` documents of a language are kept.
2. Baseline: a pair of groups starts at V times the f of two zero counts.
3. Corrections of one side: a group's terms with equal counts have equal p, so
   for each of its distinct counts, and each other group, their number times what
   f differs from the baseline. They assume a zero count on the other side.
4. Corrections of both sides: an inverted index has a posting for each term, the
   groups that have it, in blocks of ``block_groups``; each pair of a posting
   corrects what step 3 assumed twice. Zero corrections are not emitted, and the
   rest are summed in each task before they shuffle.
5. Pairs are ranked by group; terms over-represented in a group are ranked by a
   window whose limit cuts each task's rows before they meet.

Only integers are used: longs, and decimals of 38 digits where a product needs
them. Languages and sources are texts, so a pair is named by its two sources; the
number of pairs is that of the result.

Defined cases: null text, language or source is ''; a group without kept terms
takes part with zero counts; a language without kept terms has V = 0 and pairs of
value 0; a language of one source has no pair; repeated rows count each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.resampling import LOWER

LEAST_DOCS, TOP_TERMS, SCALE, BLOCK_GROUPS = 10, 10, 1_000_000_000, 128
#: Different (group, term) pairs that a task holds before it passes their counts on.
HELD = 300_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = "lang string, source string, term string, n long, docs long"


def group_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it): counts of all whole texts. A row without a term stands for each group met (term null)."""
    common.small_batches(docs.sparkSession)

    def work(batches):
        counts: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        held = 0

        def rows():
            for (a, b), own in counts.items():
                terms = [None, *(t.decode("utf-8", "replace") for t in own)]
                n, d = [0, *(x[0] for x in own.values())], [0, *(x[1] for x in own.values())]
                yield pa.RecordBatch.from_arrays([pa.array([a] * len(n)), pa.array([b] * len(n)), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for a, b, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = counts.setdefault((a, b), {})
                before = len(own)
                for term, n in Counter(_TERM.findall(t.encode("utf-8", "replace").translate(LOWER))).items():
                    got = own.get(term)
                    if got is None:
                        own[term] = [n, 1]
                    else:
                        got[0] += n
                        got[1] += 1
                held += len(own) - before
                if held > HELD:
                    yield from rows()
                    counts, held = {}, 0
        yield from rows()

    texts = docs.select(*[F.coalesce(F.col(common.quoted(c)).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    return texts.mapInArrow(work, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chance(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly."""
    c, n, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, kept))
    whole = "decimal(28,0)"
    return F.lit(1).cast("long") + _div((c + 2).cast(whole) * F.lit(SCALE).cast("decimal(10,0)"), (n + 2 * v).cast(whole))


def _div(a: Column, b: Column) -> Column:
    """Integral quotient, a long, of two integers that are not negative."""
    return F.call_function("div", a, b)


def divergence(p: Column | str, q: Column | str) -> Column:
    """floor((p - q)^2 / (p + q)) of two longs of at most 10^9 + 1."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return _div((p - q) * (p - q), p + q)


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_groups: int = BLOCK_GROUPS,
) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has each other source of the language, part ``term`` the ``top_terms`` terms that the source uses more."""
    counted = common.written(group_terms(docs, text, lang, source), "group-terms")
    vocabulary = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs)
    kept = counted.where("term is not null").join(vocabulary.drop("docs"), ["lang", "term"])
    kept = common.written(kept.select("lang", "source", "term", "n", "all_n"), "kept-terms")
    # Facts of the languages (V, N) and of the groups (N, p of a zero count): a row each.
    size = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counted.where("term is null").select("lang", "source").join(size, "lang", "left").join(own, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "lang_n", "group_n")])
    # Without kept terms no p is used; the 1 only keeps the division defined.
    zero = F.when(F.col("v") > 0, chance(F.lit(0), "group_n", "v")).otherwise(F.lit(1))
    groups = common.written(groups.withColumn("zero", zero), "groups")
    entries = kept.join(groups, ["lang", "source"]).withColumn("p", chance("n", "group_n", "v"))
    entries = common.written(entries.select("lang", "source", "term", "n", "p", "zero", chance("all_n", "lang_n", "v").alias("q"), "v"), "postings")
    return _pairs(groups, entries, block_groups).unionByName(_terms(entries, top_terms))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _terms(entries: DataFrame, top_terms: int) -> DataFrame:
    more = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
    return _ranked(more).where(F.col("rank") <= top_terms)


def _pairs(groups: DataFrame, entries: DataFrame, block_groups: int) -> DataFrame:
    def others(rows: DataFrame) -> DataFrame:
        """Rows of a group beside each other group of the language."""
        there = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
        return rows.join(there, "lang").where(F.col("source") != F.col("other"))

    both_zero = divergence("zero", "other_zero")
    base = others(groups).where(F.col("source") < F.col("other")).select("lang", F.col("source").alias("a"), F.col("other").alias("b"), (F.col("v") * both_zero).alias("value"))
    alike = entries.groupBy("lang", "source", "zero", "p").agg(F.count(F.lit(1)).alias("times"))
    single = others(alike).select(
        "lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("times") * (divergence("p", "other_zero") - both_zero)).alias("value")
    )
    # Postings in blocks: a pair of blocks of one term is one row, whatever the number of groups that have the term.
    blocks_of = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block_groups).alias("_blocks"))
    dealt = entries.join(blocks_of, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "_blocks"))
    postings = common.written(dealt.groupBy("lang", "term", "block").agg(F.collect_list(F.struct("source", "p", "zero")).alias("list")), "inverted-index")
    right = postings.select("lang", "term", F.col("block").alias("other_block"), F.col("list").alias("other_list"))
    met = postings.join(right, ["lang", "term"]).where("block <= other_block")
    met = met.select("lang", F.explode("list").alias("x"), "other_list", (F.col("block") == F.col("other_block")).alias("_one")).select("lang", "x", "_one", F.explode("other_list").alias("y"))
    met = met.where(F.when(F.col("_one"), F.col("x.source") < F.col("y.source")).otherwise(F.lit(True)))
    p, q, u, v = F.col("x.p"), F.col("y.p"), F.col("x.zero"), F.col("y.zero")
    correction = divergence(p, q) - divergence(p, v) - divergence(u, q) + divergence(u, v)
    double = met.select("lang", F.least("x.source", "y.source").alias("a"), F.greatest("x.source", "y.source").alias("b"), correction.alias("value")).where("value != 0")
    total = base.unionByName(single).unionByName(double).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(total.select("lang", "value", ways.alias("_w")).select("lang", "_w.source", F.lit("pair").alias("part"), "_w.item", "value"))


_P = "1 + 1000000000::HUGEINT * ({} + 2) // ({} + 2 * v)"
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS group_n, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang), 0) AS lang_n
  FROM groups x LEFT JOIN sizes USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format("coalesce(c.n, 0)", "group_n")} AS p, {_P.format("w.n", "lang_n")} AS q
  FROM g JOIN kept k USING (lang) JOIN whole w USING (lang, term) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
