"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: the sources, ordered by code point with null last, weigh 5, 2, 1, repeating, and share the sum
of all sizes; no target passes EPOCHS times its source's size, the excess is shared again by weight.

Each source's documents fall into permuted blocks by a seeded hash. A target is met with whole epochs
and, for the rest, with a prefix of a permutation of the blocks. The block on the border and a few after it are cut into
blocks again, of which again a prefix is taken, until no more than FILL documents of a source remain, which are
taken one by one wherever they still fit; so a source comes as near its target as those allow, however many documents it has.

One block in one epoch is a unit. The tree starts from each source's exact number of units and splits it between the halves of
the range of shards with a multivariate hypergeometric draw, down to single shards; a shard then takes the
next units of a second permutation, so units are disjoint and every quota is exact. Beyond GROUPS shards the tree ends at groups of
shards, and each unit's documents are dealt evenly to the shards of its group by the ranges of a hash. Within a shard,
documents are ordered by a hash.

The driver holds one row per source (the mixture's weights are set per source, so the list of
sources is configuration; more than MOST_SOURCES raise a ValueError) and the tree's non-empty quotas, no more than the units: at most
(EPOCHS + 1) * MOST_BLOCKS a source, whatever the number of documents.

Defined edge cases: a null text has size 0; null is a source of its own; repeated rows are taken row by
row, told apart by a number that is written with them (those equal in id and text share a block and a shard); sources of size 0 have target 0 and are not taken; an empty table gives an
empty mix; clashing column names are avoided by computing on a projection. Reruns agree: all draws are seeded, and hashes are of ids and texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Cut, n_words, small_side, table

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 8
#: Documents of a block, about, and most blocks of a source.
BLOCK_DOCS, MOST_BLOCKS = 64, 4096
#: Blocks at the border of a source's target that are cut again, and most documents of a source that are taken one by one.
BORDER, FILL = 4, 2048
#: A shard holds about this many words; there are SHARDS of them at least.
SHARD_WORDS, SHARDS = 1 << 24, 64
#: Most groups of shards that the tree tells apart.
GROUPS = 1024
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS) -> list[float]:
    """The words to take of each source, in the order given."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        total = sum(weight[i] for i in open_)
        share = {i: rest * weight[i] / total for i in open_}
        over = [i for i in open_ if share[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split(quotas: list[int], shards: int, seed: int = SEED) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, each source's exact number of units) for the shards that get any; the numbers sum to the quotas."""
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        lo, hi, q = todo.pop()
        if not q.sum():
            continue
        if hi - lo == 1:
            yield lo, q
            continue
        mid = (lo + hi) // 2
        draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, int(q.sum() * (mid - lo) // (hi - lo)), method="marginals")
        todo += [(lo, mid, draw), (mid, hi, q - draw)]


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: Column | None = None) -> Cut:
    """The rows as (at, id, source, size, h) and, if given, row, written with a number of their own."""
    own = [F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), n_words(f"`{text}`").alias("size"), F.xxhash64(F.lit(SEED), F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h")]
    return Cut(docs.select(F.monotonically_increasing_id().alias("at"), *own, *([] if row is None else [row.alias("row")])), "mix-rows")


def _same(a: str, b: str, *names: str) -> Column:
    """Whether two tables agree in the columns, of which source may be null."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) if n == "source" else F.col(f"{a}.{n}") == F.col(f"{b}.{n}") for n in names))


def _prefix(blocked: DataFrame, level: int) -> DataFrame:
    """(source, block, part) of rows with source, block, size and room: part is 1 for blocks of a prefix that fits, 0 for others, null for the border, with the room that is left.

    A source has at most MOST_BLOCKS blocks, so its windows are small.
    """
    turn = W.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED + 2 + 16 * level), "block"), "block")
    held = blocked.groupBy("source", "block").agg(F.sum("size").alias("w"), F.max("room").alias("room"))
    placed = held.withColumn("before", F.sum("w").over(turn.rowsBetween(W.unboundedPreceding, 0)) - F.col("w")).withColumn("turn", F.row_number().over(turn))
    left = F.col("room") - F.col("before")
    here = (left > 0) & (left < F.col("w"))
    all_ = W.partitionBy("source")
    placed = placed.withColumns({"rest": F.max(F.when(here, left)).over(all_), "from": F.min(F.when(here, F.col("turn"))).over(all_)})
    border = F.col("rest").isNotNull() & (F.col("turn") >= F.col("from")) & (F.col("turn") < F.col("from") + BORDER)
    part = F.when(border, F.lit(None)).when(left > 0, 1).otherwise(0)
    return placed.select("source", "block", part.cast("int").alias("part"), F.when(border, F.col("rest")).alias("rest"))


class Mix:
    """The plan of a mix of numbered rows: each row's size, source's size, target, copies, and the shards of the copies."""

    def __init__(self, rows: Cut, shards: int | None = None):
        spark = rows.spark
        self.sized = rows.df.select("at", "id", "source", "size", "h")
        found = self.sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
        if len(found) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources; group them before mixing")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        words = [r.words for r in found]
        self.target = targets(words)
        epochs = [int(t / w + 1e-9) if w else 0 for t, w in zip(self.target, words, strict=True)]
        schema = "source string, source_size long, target double, epochs int, room double, blocks int"
        values = [(r.source, w, t, e, max(0.0, t - e * w), max(1, min(MOST_BLOCKS, ceil(r.docs / BLOCK_DOCS)))) for r, w, t, e in zip(found, words, self.target, epochs, strict=True)]
        self.sources = F.broadcast(spark.createDataFrame(values, schema))  # at most MOST_SOURCES rows

        every = self.blocked(self.sized)
        parts = Cut(_prefix(every.select("source", "block", "size", "room"), 0).join(self.sources.select(F.col("source").alias("s"), "epochs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-blocks")
        count = F.col("epochs") + F.coalesce(F.col("part"), F.lit(1))
        units = Cut(parts.df.where(count > 0).select("source", "block", F.explode(F.sequence(F.lit(1), count)).alias("copy")), "mix-units")
        held = {r.source: r.n for r in units.df.groupBy("source").agg(F.count("*").alias("n")).collect()}
        self.shards = shards or max(SHARDS, ceil(sum(words) / SHARD_WORDS))
        self.groups = min(self.shards, GROUPS)
        taken = [0] * len(found)
        ranges = []
        for group, quota in split([held.get(r.source, 0) for r in found], self.groups):
            for i in np.flatnonzero(quota).tolist():
                ranges.append((found[i].source, group, taken[i] + 1, taken[i] + int(quota[i])))
                taken[i] += int(quota[i])
        dealt = spark.createDataFrame(ranges, "source string, group int, lo long, hi long").select("source", "group", F.explode(F.sequence("lo", "hi")).alias("turn"))
        turn = F.row_number().over(W.partitionBy("source").orderBy(F.xxhash64(F.lit(SEED + 3), "block", "copy"), "block", "copy")).cast("long")  # a source's units only
        drawn = units.df.withColumn("turn", turn).alias("u").join(dealt.alias("d"), _same("u", "d", "source", "turn")).select("u.source", "block", F.struct("copy", "group").alias("unit"))
        drawn = drawn.groupBy("source", "block").agg(F.array_sort(F.collect_list("unit")).alias("units"))
        self.by_block = Cut(parts.df.alias("p").join(drawn.alias("u"), _same("p", "u", "source", "block"), "left").select("p.source", "p.block", "part", "rest", "epochs", "units"), "mix-units")
        self.border = Cut(self._filled(every.alias("r").join(small_side(self.by_block).where("part is null").alias("b"), _same("r", "b", "source", "block")).select("at", "r.source", "h", "size", F.col("rest").alias("room"))), "mix-border")

    def blocked(self, rows: DataFrame) -> DataFrame:
        """The rows with what holds for their source, and the block that follows from h."""
        block = F.pmod(F.xxhash64(F.lit(SEED + 1), "h"), F.col("blocks")).cast("int")
        return rows.alias("d").join(self.sources.alias("s"), _same("d", "s", "source")).select("d.*", "source_size", "target", "room", block.alias("block"))

    def _filled(self, region: DataFrame) -> DataFrame:
        """(at, take) for the rows of the border: 1 for those in a prefix of smaller and smaller blocks, and one by one at last."""
        done, level = [], 0
        while True:
            level += 1
            region = Cut(region, "mix-region").df
            sizes = region.groupBy("source").agg(F.count("*").alias("docs"))
            if sizes.where(F.col("docs") > FILL).isEmpty():
                break
            counted = Cut(sizes.select("source", F.when(F.col("docs") > FILL, F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS))).cast("int").alias("blocks")), "mix-sizes")
            rows = region.alias("r").join(F.broadcast(counted.df).alias("c"), _same("r", "c", "source"))  # a row per source
            rows = rows.select("r.*", "blocks", F.pmod(F.xxhash64(F.lit(SEED + 1 + 16 * level), "h"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
            parts = Cut(_prefix(rows.where("blocks is not null"), level), "mix-parts")
            cut = rows.alias("r").join(small_side(parts).alias("p"), _same("r", "p", "source", "block") & F.col("r.blocks").isNotNull(), "left")
            cut = Cut(cut.select("r.at", "r.source", "h", "size", F.coalesce("rest", "room").alias("room"), "part"), "mix-cut").df
            done.append(cut.where("part is not null").select("at", F.col("part").alias("take")))
            region = cut.where("part is null").drop("part")
        last = region.groupBy("source").applyInPandas(_fill, "at long, take int")  # at most FILL rows of a source
        return reduce(DataFrame.unionByName, done, last)

    def plan(self, rows: DataFrame) -> DataFrame:
        """The rows with source_size, target and units, which has a (copy, shard) for each time the mix takes the row."""
        rows = self.blocked(rows).alias("d").join(small_side(self.by_block).alias("b"), _same("d", "b", "source", "block")).select("d.*", "part", "epochs", "units")
        rows = rows.alias("d").join(small_side(self.border).select(F.col("at").alias("edge"), "take"), F.col("part").isNull() & (F.col("d.at") == F.col("edge")), "left")
        # the shard within its group: a stretch of the range of a hash of row and copy, so that a unit is dealt evenly
        first = lambda g: F.floor(g.cast("long") * self.shards / self.groups).cast("int")
        share = lambda u: F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 5), F.col("h"), u["copy"]), 33) / float(1 << 31)
        shard = lambda u: first(u["group"]) + F.floor(share(u) * (first(u["group"] + 1) - first(u["group"]))).cast("int")
        units = F.transform(F.coalesce("units", F.array().cast("array<struct<copy:int,group:int>>")), lambda u: F.struct(u["copy"].alias("copy"), shard(u).alias("shard")))
        count = F.col("epochs") + F.coalesce("part", "take", F.lit(0))
        return rows.withColumn("units", F.slice(units, F.lit(1), count)).drop("part", "epochs", "edge", "take", "room", "block")


def _fill(border: pd.DataFrame) -> pd.DataFrame:
    """take: 1 for the documents, in the order of h, that the rest of the target has room for, and for one more if that comes nearer."""
    border = border.sort_values(["h", "size", "at"], kind="stable")
    room, take = float(border["room"].iloc[0]), []
    for size in border["size"].tolist():
        take.append(int(size <= room))
        room -= size * take[-1]
    over = [(size - room, i) for i, (size, t) in enumerate(zip(border["size"].tolist(), take, strict=True)) if not t and size - room < room]
    if over:
        take[min(over)[1]] = 1
    return pd.DataFrame({"at": border["at"], "take": np.array(take, np.int32)})


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None) -> DataFrame:
    """The mix itself: every taken copy of a row with its columns, plus mix_copy and mix_shard, dealt to its shard in shuffled order.

    The columns mix_copy and mix_shard replace any of these names. A row's block tells its copies; only the rows of the border
    look them up by their number.
    """
    rest = [c for c in docs.columns if c not in ("mix_copy", "mix_shard")]
    rows = numbered(docs, key, text, source, F.struct(*(F.col(f"`{c}`") for c in rest)))  # packed: no column of the input can clash
    taken = Mix(rows, shards).plan(rows.df).select("row", "h", F.explode("units").alias("unit"))
    dealt = taken.select("row", F.col("unit.copy").alias("copy"), F.col("unit.shard").alias("shard"), F.xxhash64(F.lit(SEED + 4), "h", "unit.copy").alias("turn"))
    return dealt.repartition(F.col("shard")).sortWithinPartitions("shard", "turn").select("row.*", F.col("copy").alias("mix_copy"), F.col("shard").alias("mix_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "documents"))
    plan = Mix(rows).plan(rows.df)
    copies = F.size("units")
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.alias("copies"), F.array_join(F.transform("units", lambda x: x["shard"].cast("string")), ",").alias("shards"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
