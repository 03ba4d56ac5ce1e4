"""Divergence of a language's sources by their terms, in relational operations only.

Terms are the matches of TERM with A-Z lower-cased, sorted within a text, so that a document counts once for a term where the term before differs. A language keeps the terms that LEAST of its documents hold. The groups
(lang, source) cross the kept terms of their language, with 0 where a group lacks a term; p is a term's smoothed
share in a group, q that in the language. The divergence of two sources sums f = (p-q)^2 / (p+q) over all kept terms, by a self-join on
language and term; f is symmetric, so each pair is joined once and read both ways. A group's terms rank by f against its language.

A term that every document holds, and a source or language with most of them, are summed before any shuffle. The cross of groups and terms is a broadcast of the
groups if they are few, counted and sized, and else a join that spreads a language's terms over SALTS keys and repeats the groups for each; the self-join
goes by language and term, so no source or language is one task's. All arithmetic is in whole numbers, decimals where 63 bits could overflow.

Defined edge cases: null text, lang and source read as ''; every row is a document, repeated ones too; a text without terms still makes its group
occur; without kept terms pairs have the value 0 and there are no terms; a language of one source has no pairs; ties go by UTF-8 order of the
item; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Cut, passing, small_side, table

#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: What lies between them: cutting a text there takes a fifth of the time of extracting the matches.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, SCALE, TOP = 10, 1_000_000_000, 10
SALTS = 256


def terms(text: Column) -> Column:
    """The sorted terms of a text, repeats included."""
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.sort_array(F.array_remove(F.split(lowered, BETWEEN), ""))


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> Cut:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents that hold it; a null term for a group that occurs.

    A text's sorted terms are exploded beside the terms before them; where the two differ a document's first occurrence of the term stands. The term before
    the end that none follows makes the row of the group.
    """
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(read(lang).alias("lang"), read(source).alias("source"), terms(read(text)).alias("all"))
    beside = F.arrays_zip(F.col("all").alias("term"), F.concat(F.array(F.lit("")), "all").alias("before"))
    each = rows.select("lang", "source", F.explode(beside).alias("t")).select("lang", "source", "t.term", (F.col("t.term") != F.col("t.before")).cast("long").alias("first"))
    return Cut(each.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs")), "term-counts")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 kept)), exactly."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * big(count + 2), big(total + 2 * kept))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of a language's sources, and each source's TOP terms against its language."""
    with passing() as keep:
        held = counts(docs, text, lang, source)
        vocabulary = held.df.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST)
        words = Cut(vocabulary.select("lang", "term", "whole"), "kept-terms")
        langs = Cut(words.df.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("words")), "langs")
        kept = held.df.join(small_side(words), ["lang", "term"])
        totals = Cut(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), "group-totals")
        all_groups = held.df.where("term is null").select("lang", "source")
        groups = keep(Cut(all_groups.join(small_side(totals), ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total")), "groups"))

        rated = words.df.join(small_side(langs), "lang").select("lang", "term", "v", _share(F.col("whole"), F.col("words"), F.col("v")).alias("q"))
        if groups.small():
            crossed = rated.join(F.broadcast(groups.df), "lang")
        else:
            salted = rated.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
            crossed = salted.join(groups.df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"])
        own = held.df.where("term is not null").select("lang", "source", "term", "n")
        dense = crossed.join(own, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
        dense = Cut(dense.select("lang", "source", "term", "n", "q", _share(F.col("n"), F.col("total"), F.col("v")).alias("p")), "dense-terms")

        one, other = (dense.df.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("source", "p"), ("item", "q")))
        sums = Cut(one.join(other, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(_apart(F.col("p"), F.col("q"))).alias("value")), "source-pairs")
        both = sums.df.unionByName(sums.df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
        every = groups.df.select("lang", "source").join(groups.df.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item"))
        pairs = every.join(both, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
        told = dense.df.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
        turn = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        top = told.withColumn("rank", turn).where(F.col("rank") <= TOP)
        return keep(Cut(pairs.withColumn("rank", turn).unionByName(top), "divergence")).df


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}
ORACLES = {
    "op13_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(whole) AS words FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, kept.term, kept.whole, coalesce(c.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM dense),
rated AS (SELECT lang, source, term, n, 1 + CAST({SCALE} AS HUGEINT) * (n + 2) // (total + 2 * v) AS p, 1 + CAST({SCALE} AS HUGEINT) * (whole + 2) // (words + 2 * v) AS q FROM summed JOIN l USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM rated a JOIN rated b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
told AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM rated WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM told))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
}
