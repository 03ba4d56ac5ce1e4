"""Quotation linking: reply-ordered conversations without quoted text, in DataFrame functions only.

Each line's quote level is its number of leading ``>``. Neighbouring lines of one level form a passage.
A passage's units are itself, its paragraphs (between blank lines), its lines, and its sentences of LEAST words or more, so that a quote of a part,
or one that a client wrapped anew, still has a unit in common with its original. Units are normalised (lower case, letters and digits, single
spaces) and hashed. The original of a quoted unit is the first message of the conversation whose own passages hold it, and it has to
come before the quoting message. A message replies to the original of its largest unit, in words, among its outermost linked
quotes; of equal ones to the latest. Threads follow from pointer doubling over the reply links.

Reply order: threads by the turn of their root; within a thread by turn, so parents come before replies;
equal turns by hash. Positions come from sorted ranges and their counts, so a conversation that holds most
rows is not ranked in one task; conversations come in parts of PART messages.

Defined edge cases: null texts and roles count as empty and ``unknown``; a text of quotes alone leaves an
empty message; repeated rows count once, with their number in ``n_rows``; null ids form a conversation of
their own and null turns come last and are not linked; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Cut, small_side, table

PREFIX = r"^[ \t]*(?:>[ \t]?)+"
#: How a line ends that announces a quotation.
ANNOUNCE = r"(?i)(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$"
PART = 128
#: Words that a sentence needs to be a unit.
LEAST = 4


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, PREFIX, 0), "[^>]", ""))


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def units(passages: Column) -> Column:
    """(n, h) of the units of passages (level, lines), which may repeat: words and hash of the normalised text."""

    def of(p: Column) -> Column:
        block = F.array_join(p["lines"], "\n")
        paragraphs = F.split(block, r"\n[^\S\n]*\n\s*")
        sentences = F.flatten(F.transform(paragraphs, lambda x: F.split(x, r"(?<=[.!?。！？])\s+")))
        whole = F.transform(F.concat(F.array(block), paragraphs, p["lines"]), norm)
        long = F.filter(F.transform(sentences, norm), lambda x: F.size(F.split(x, " ")) >= LEAST)
        return F.filter(F.concat(whole, long), lambda x: x != "")

    texts = F.flatten(F.transform(passages, of))
    return F.transform(texts, lambda x: F.struct(F.size(F.split(x, " ")).alias("n"), F.xxhash64(x).alias("h")))


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct message: its own text, the hashes of its own passages, and (level, h) of its quotes."""
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit("unknown")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text")).groupBy("conv_id", "turn", "tie", "role", "text").agg(F.count("*").alias("n_rows"))
    lines = F.transform(F.split("text", "\r\n|\n|\r"), lambda x: F.struct(_level(x).alias("level"), F.regexp_replace(x, PREFIX, "").alias("text")))
    rows = rows.select("*", lines.alias("lines"), F.col("text").contains(">").alias("quotes"))
    rows = rows.select("*", F.transform("lines", lambda x: x["level"]).alias("levels"))  # computed, not extracted: an extraction would move into the lambdas, to be done for every line
    level = lambda i: F.get("levels", i)
    first = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
    rows = rows.select("*", F.when(F.col("quotes"), first).otherwise(F.array(F.lit(0))).alias("first"))

    def passage(at: Column, i: Column) -> Column:
        part = F.slice("lines", at + 1, F.coalesce(F.get("first", i + 1), F.size("lines")) - at)
        return F.struct(level(at).alias("level"), F.transform(part, lambda x: x["text"]).alias("lines"))

    rows = rows.select("*", F.transform("first", passage).alias("passages"))
    own = F.filter("passages", lambda p: p["level"] == 0)
    announced = lambda x, i: (x["level"] == 0) & ~(F.coalesce(level(i + 1) > 0, F.lit(False)) & x["text"].rlike(ANNOUNCE))
    kept = F.transform(F.filter("lines", announced), lambda x: x["text"])
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    cited = F.flatten(F.transform(quoted, lambda p: F.transform(units(F.array(p)), lambda u: F.struct(p["level"].alias("level"), u["n"].alias("n"), u["h"].alias("h")))))
    clean = F.when(F.col("quotes"), F.regexp_replace(F.array_join(kept, "\n"), r"\A\s+|\s+\z", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "tie", "role", "n_rows", clean.alias("text"), F.array_distinct(F.transform(units(own), lambda u: u["h"])).alias("own"), cited.alias("cited"), F.size(quoted).alias("n_quotes"))


def replies(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the linked messages and what they reply to; rows as parsed() gives them."""
    asked = Cut(rows.where("size(cited) > 0 and turn is not null").select("conv_id", "turn", F.explode("cited").alias("c")).select("conv_id", "turn", "c.level", "c.n", "c.h").distinct(), "cited")
    # only hashes that are quoted somewhere need an original
    wanted = Cut(asked.df.groupBy("conv_id", "h").agg(F.max("turn").alias("until")), "wanted")
    own = rows.where("turn is not null").select("conv_id", "turn", F.explode("own").alias("h")).alias("o")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    held = own.join(small_side(wanted).alias("w"), same("o", "w") & (F.col("o.turn") < F.col("w.until")))
    first = Cut(held.groupBy("o.conv_id", "o.h").agg(F.min("o.turn").alias("origin")), "origins")
    found = asked.df.alias("a").join(small_side(first).alias("f"), same("a", "f") & (F.col("origin") < F.col("turn")))
    return found.groupBy("a.conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "origin")).getField("origin").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth) by pointer doubling: as many rounds as the logarithm of the depth."""
    now = Cut(links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads")
    while True:
        up = small_side(now).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("root").alias("r"), F.col("depth").alias("d"))
        step = now.df.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t")), "left")
        new = Cut(step.select("conv_id", "turn", "parent", F.coalesce("r", "root").alias("root"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("r").isNotNull().alias("moved")), "threads")
        now.drop()
        now = new
        if now.df.where("moved").isEmpty():
            return now.df.drop("moved")


def linked(messages: DataFrame) -> DataFrame:
    """One row per distinct message with parent, root, depth and its position pos (from 0) in reply order."""
    rows = Cut(parsed(messages), "messages").df
    tree = Cut(threads(replies(rows)), "tree")
    rows = rows.alias("m").join(small_side(tree).alias("t"), F.col("m.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("m.turn") == F.col("t.turn")), "left")
    root = F.coalesce("t.root", "m.turn")
    rows = rows.select("m.*", F.col("t.parent").alias("parent"), root.alias("root"), F.coalesce("t.depth", F.lit(0)).alias("depth")).drop("own", "cited")
    # rows are dealt out in sorted ranges, which may cut a conversation anywhere; the rest is arithmetic on range counts
    order = [F.asc_nulls_last(c) for c in ("conv_id", "root", "turn", "tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    dealt = Cut(dealt.withColumn("range", F.shiftright("id", 33)), "ordered").df
    ranges = dealt.groupBy("conv_id", "range").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    base = Cut(ranges.select("conv_id", "range", (F.col("low") - ahead).alias("zero")), "ranges")
    placed = dealt.alias("p").join(small_side(base).alias("b"), F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("p.range") == F.col("b.range")))
    return placed.select("p.conv_id", "turn", "role", "text", "n_rows", "n_quotes", "parent", "root", "depth", (F.col("id") - F.col("zero")).alias("pos"))


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, part, n_messages, n_links, turns, parents, chat): parts of at most PART messages in reply order."""
    safe = F.regexp_replace("text", r"<\|(im_start|im_end)\|>", "<$1>")
    one = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), safe, F.lit("<|im_end|>\n"))
    rows = linked(messages).select("conv_id", F.floor(F.col("pos") / PART).alias("part"), F.struct("pos", "turn", "parent", one.alias("chat")).alias("m"))
    whole = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return whole.select("conv_id", "part", F.size("m").alias("n_messages"), F.size(F.filter("m.parent", lambda x: x.isNotNull())).alias("n_links"), F.col("m.turn").alias("turns"), F.col("m.parent").alias("parents"), F.array_join("m.chat", "").alias("chat"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))


QUERIES = {"op4_quotes": op4_quotes}
ORACLES: dict[str, str] = {}
