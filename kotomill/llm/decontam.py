"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become lower-case tokens: runs of letters and digits, and single characters of scripts that write no spaces. A seed hashes
tokens at fixed offsets and ignores those between, so a substituted word only spoils the seeds that look at it. The two masks of
five tokens are chosen so that any 13 tokens with two substitutions, and any 20 with four, keep at least one seed whole.
Shorter items are cut into parts, one or two more than the substitutions that SHARE allows them, and seeded by all
but as many parts: whichever tokens are substituted, one seed looks at none of them, and every seed looks at two fifths of the item or more.

Seeds of documents and of benchmark items are joined; a hit fixes an alignment (item, document position
minus item position). Around each hit only the item's stretch of the document is cut out and compared: it is a leak if some WINDOW
consecutive item tokens (the whole item, if shorter) agree with the document in at least SHARE of them.
Items under LEAST tokens, such as "yes" or "in 1492", occur in any prose; they leak where they are a whole line of a document, token by token.

Hits belong to texts, by the hash of the text, so neither a null key nor a repeated one gathers the hits of other rows.

Defined edge cases: null and empty texts have no leaks, items without a token are in no document; repeated rows and tied alignments
give one row per key and item, with the best agreement; a null doc_id is a key of its own; ``clean`` removes rows by their text; empty
tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, passing, small_side, table

#: Scripts without spaces between words; each of their characters is a token.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+|[{UNSPACED}&&[\p{{L}}\p{{N}}]]"
#: Texts without any of these characters have no such script and are cut by the plain rule, which is faster.
WIDE, PLAIN = r"[\x{E00}-\x{1DFF}\x{2E80}-\x{10FFFF}]", r"[\p{L}\p{N}]+"
#: Offsets of the tokens that each mask looks at.
MASKS = ((0, 2, 4, 5, 6), (0, 5, 6, 8, 9))
WINDOW, SHARE, LEAST = 13, 0.8, 5
#: Items from here on are seeded by the masks.
MASKED = WINDOW


def tokens(text: Column) -> Column:
    """Hashes of the tokens, in order; null and empty texts have none."""
    body = F.coalesce(text, F.lit(""))
    cut = lambda pattern: F.regexp_extract_all(F.lower(body), F.lit(pattern), F.lit(0))
    return F.transform(F.when(body.rlike(WIDE), cut(TOKEN)).otherwise(cut(PLAIN)), lambda w: F.xxhash64(w))


def seeds(words: Column, n: Column, shapes: list[tuple[int, ...]]) -> Column:
    """An array of (h, pos) for every shape at every position."""
    none = F.array().cast("array<struct<h:bigint,pos:int>>")

    def of(shape: tuple[int, ...]) -> Column:
        last = n - F.lit(shape[-1] + 1)
        seed = lambda i: F.struct(F.xxhash64(F.lit(str(shape)), *(F.get(words, i + o) for o in shape)).alias("h"), i.alias("pos"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), seed)).otherwise(none)

    return F.concat(*map(of, shapes))


def short_seeds(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(place in the item, offsets from there) of the seeds of an item of n tokens, fewer than MASKED: of any tokens that may be substituted, one seed has none."""
    lost = n - ceil(n * SHARE)
    parts = lost + 2
    cuts = [n * k // parts for k in range(parts + 1)]
    out = []
    for gone in combinations(range(parts), lost):
        kept = [i for k in range(parts) if k not in gone for i in range(cuts[k], cuts[k + 1])]
        out.append((kept[0], tuple(i - kept[0] for i in kept)))
    return out


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def leaks(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_tokens, agree, share): one row per leaked pair."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("body"), _text_key(text).alias("th"))
    pairs = leaked_texts(rows.select("th", "body"), bench.select(F.col(item).alias("item"), F.col(item_text).alias("words")))
    found = rows.select("k", "th").join(small_side(pairs), "th").groupBy("k", "item", "n").agg(F.max("agree").alias("agree"), F.max("share").alias("share"))
    return found.select(F.col("k").alias(key), F.col("item").alias(item), F.col("n").alias("n_tokens"), "agree", "share")


def leaked_texts(texts: DataFrame, bench: DataFrame) -> Cut:
    """(th, item, n, agree, share) of the texts (th, body) and items (item, words)."""
    with passing() as keep:
        items = Cut(bench.select("item", tokens(F.col("words")).alias("it")).withColumn("n", F.size("it")).where("n > 0").distinct(), "items")
        short = sorted(r.n for r in items.df.where(F.col("n") < MASKED).select("n").distinct().collect())  # at most MASKED lengths
        seeded = [(n, place, shape) for n in short if n >= LEAST for place, shape in short_seeds(n)]
        shapes = [*MASKS, *sorted({shape for *_, shape in seeded})]
        of_items = items.df.where(F.col("n") >= MASKED).select("item", F.explode(seeds(F.col("it"), F.col("n"), list(MASKS))).alias("s"))
        for n, place, shape in seeded:
            own = F.filter(seeds(F.col("it"), F.col("n"), [shape]), lambda s, place=place: s["pos"] == place)
            of_items = of_items.unionByName(items.df.where(F.col("n") == n).select("item", F.explode(own).alias("s")))
        known = Cut(of_items.select("item", F.col("s.h").alias("h"), F.col("s.pos").alias("at")), "item-seeds")

        cut = texts.select("th", tokens(F.col("body")).alias("dt")).withColumn("n", F.size("dt"))
        spread = cut.select("th", F.explode(seeds(F.col("dt"), F.col("n"), shapes)).alias("s")).select("th", F.col("s.h").alias("h"), F.col("s.pos").alias("pos"))
        hits = Cut(spread.join(small_side(known), "h").select("th", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "hits")

        # only texts with hits are read again and cut into tokens; of each hit the item's stretch travels on
        sized = hits.df.join(small_side(items).select("item", "n").distinct(), "item")
        per_text = Cut(sized.groupBy("th").agg(F.collect_set(F.struct("item", "shift", "n")).alias("hits")), "text-hits")
        again = texts.join(small_side(per_text), "th").dropDuplicates(["th"]).select("th", tokens(F.col("body")).alias("dt"), "hits")

        def stretch(h: Column) -> Column:
            lo, hi = F.greatest(F.lit(0), -h["shift"]), F.least(h["n"], F.size("dt") - h["shift"])
            return F.struct(h["item"].alias("item"), h["n"].alias("n"), lo.alias("lo"), F.slice("dt", lo + h["shift"] + 1, F.greatest(F.lit(0), hi - lo)).alias("part"))

        aligned = again.select("th", F.explode(F.transform("hits", stretch)).alias("h")).select("th", "h.*")
        aligned = aligned.alias("a").join(small_side(items).alias("i"), (F.col("a.item") == F.col("i.item")) & (F.col("a.n") == F.col("i.n"))).select("th", "a.item", "a.n", "lo", "part", "it")
        # 1 where item and document agree; positions of the item outside the document are 0
        same = F.transform("it", lambda w, i: F.coalesce((i >= F.col("lo")) & (w == F.get("part", F.greatest(F.lit(0), i - F.col("lo")))), F.lit(False)).cast("int"))
        width = F.least(F.lit(WINDOW), F.col("n"))
        count = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
        in_window = F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda i: count(F.slice("same", i, width)))
        scored = aligned.select("th", "item", "n", same.alias("same")).select("th", "item", "n", count("same").alias("agree"), F.array_max(in_window).alias("best"), width.alias("width"))
        need = F.when(F.col("width") == WINDOW, ceil(WINDOW * SHARE)).otherwise(F.ceil(F.col("width") * SHARE))
        found = scored.where(F.col("best") >= need).groupBy("th", "item", "n").agg(F.max("agree").alias("agree"), F.max(F.col("best") / F.col("width")).alias("share"))
        if short and short[0] < LEAST:
            whole = Cut(items.df.where(F.col("n") < LEAST).select("item", "n", F.xxhash64("it").alias("h")).distinct(), "short-items")
            lines = texts.select("th", F.explode(F.split("body", "\r\n|\n|\r")).alias("line")).select("th", tokens(F.col("line")).alias("lt")).where(F.size("lt").between(1, LEAST - 1))
            alone = lines.select("th", F.xxhash64("lt").alias("h")).join(small_side(whole), "h").select("th", "item", "n").distinct()
            found = found.unionByName(alone.select("th", "item", "n", F.col("n").alias("agree"), F.lit(1.0).alias("share")))
        return keep(Cut(found, "leaked-texts"))


def clean(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any leak, columns unchanged."""
    texts = docs.select(_text_key(f"`{text}`").alias("th"), F.col(f"`{text}`").alias("body"))
    pairs = leaked_texts(texts, bench.select(F.col("item_id").alias("item"), F.col("text").alias("words")))
    leaked = small_side(Cut(pairs.df.select(F.col("th").alias("leaked")).distinct(), "leaked"))
    return docs.join(leaked, _text_key(f"`{text}`") == leaked["leaked"], "left_anti")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
_SPACED = r"regexp_replace(lower({}), '([\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}])', ' \1 ', 'g')"
_WORDS = rf"regexp_extract_all({_SPACED}, '[\p{{{{L}}}}\p{{{{N}}}}]+')"
ORACLES = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
it AS (SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM i WHERE len(w) >= 5),
same AS (SELECT doc_id, item_id, n, dt.p - it.p AS shift, it.p FROM dt JOIN it USING (t)),
near AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS c FROM same),
lines AS (SELECT doc_id, item_id, n, shift, count(*) AS agree, max(c) AS best, least(13, n) AS width FROM near GROUP BY ALL),
alone AS (SELECT doc_id, {_WORDS.format("line")} AS w FROM (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents)),
every AS (SELECT doc_id, item_id, n, agree, best / width AS share FROM lines WHERE best >= ceil(width * 0.8)
UNION ALL SELECT doc_id, item_id, len(i.w), len(i.w), 1.0 FROM alone JOIN i USING (w) WHERE len(i.w) BETWEEN 1 AND 4)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_tokens, CAST(max(agree) AS INTEGER) AS agree, max(share) AS share FROM every GROUP BY doc_id, item_id, n
"""
}
