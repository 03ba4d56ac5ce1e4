"""Near copies by Golay-keyed SimHash: texts whose sets of WIDTH-word shingles have a Jaccard similarity of at least LEAST.

The words are those of ``simhash``; fewer than WIDTH words are one shingle. A text's SimHash over its
distinct shingles has 256 bits, of which eleven segments of 23 bits are read as words of the Golay code.
``Golay.near`` names the codewords near a segment, five on average; two segments that differ in at most two
bits always share one, and in three or four bits more often than not. By the pigeonhole principle,
fingerprints within 32 bits have such a segment. A codeword index alone has 12 bits, under which unrelated texts meet
in numbers that grow with the square of the corpus, so each segment's keys also hold an anchor, the
smallest of the shingles' hashes in an order of its own: texts without common shingles never meet, and
texts that share only a passage meet under few keys. A pair at similarity 0.8 agrees in an anchor with
probability 0.8 and in the segment beside it with 0.6, so it misses all eleven with probability 0.0007;
at 0.9 with 10^-6.

A meeting is verified twice: on a SimHash of 1024 bits, of which two texts at 0.8 differ in 155 on average, 11.5 being the
standard deviation, and more than FAR of them in 3 of 10,000 cases; then on the whole shingle sets.

Equal texts are one node. Each member is first compared with the lead of its fullest key's group, the node that
meets most others in all its groups; then, for ROUNDS rounds or until one links at most FEW, the members outside the largest
component of their fullest group that has several with the one that leads them there. Pairs inside one component cannot change it and are left out, so a large group of near copies costs a
multiple of its size.

The nodes of groups that still hold several components are compared by the rarest shingles of their sets: two sets of n and m shingles are alike only if they share
c = LEAST (n + m) / (1 + LEAST), so of either set in one order the first n - c + 1 (m - c + 1) hold the first shared one. The order is that of how many of these nodes have a shingle; those that
lead to no other component come first, so that nodes with many shingles of their own meet nobody, however many share the rest. This leaves out no pair that is alike, and a pair counts under its first
shared shingle only. Before that, each is compared with the lead of those that it meets.

Defined edge cases: null and empty texts and texts without a word are copies of each other; nodes are
64-bit hashes of texts and shingles 64-bit hashes of words; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut, passing, settled, small_batches, small_side, tidy
from .components import components
from .simhash import LENGTH, Golay, counted

WIDTH, SEED = 5, 42
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Segments of the keys' fingerprint, 64-bit words of the wide one, and the most bits of it in which near copies differ.
SEGMENTS, WORDS, FAR = 11, 16, 194
#: Rounds of comparisons with leads after the first.
ROUNDS = 2
#: A round that links no more than this is the last.
FEW = 4
PRINT = tuple(f"f{i}" for i in range(WORDS))

_RANDOM = np.random.default_rng(SEED)
_XOR, _ODD = (_RANDOM.integers(0, 1 << 64, SEGMENTS, np.uint64) for _ in range(2))
_ODD |= np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1)
_WIDE = _RANDOM.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_PLACE = 1 << np.arange(LENGTH - 1, -1, -1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct 128-bit hashes of a text's shingles as rows of two words, by the first of them."""
    words = text.encode().lower().split() if text else []
    if len(words) < WIDTH:
        found = [xxhash.xxh3_128_digest(b" ".join(words), SEED)] if words else []
    else:
        found = [xxhash.xxh3_128_digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(WIDTH)), strict=False)]
    every = np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)
    return every[np.unique(every[:, 0], return_index=True)[1]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def fingerprint(found: np.ndarray, words: int) -> np.ndarray:
    """The bits of the SimHash of a set of shingles, so many 64-bit words of it; a wider one begins like a narrower one."""
    bits = np.zeros(64 * words, np.int64)
    for at in range(0, len(found), 1024):  # bounded memory on very long texts
        part = found[at : at + 1024]
        wide = [part, *(_mixed(part[:, :1] * _WIDE[k] ^ part[:, 1:]) for k in range(2, words))]
        bits += counted(np.ascontiguousarray(np.concatenate(wide, axis=1)).view(np.uint8))
    return 2 * bits > len(found)


def anchors(found: np.ndarray) -> np.ndarray:
    """The smallest hash of the set in each of the orders."""
    low = np.full(SEGMENTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        low = np.minimum(low, ((found[at : at + 4096, :1] ^ _XOR) * _ODD).min(0))
    return low


def keys(bits: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of rows of fingerprint bits and anchors: an anchor, a segment's number and a codeword near it."""
    words = (bits[:, : LENGTH * SEGMENTS].reshape(-1, LENGTH) @ _PLACE).astype(np.int32)
    at, home = Golay.get().near(words, LENGTH)
    segment = (at % SEGMENTS).astype(np.uint64) << np.uint64(12) | home.astype(np.uint64)
    return at // SEGMENTS, _mixed(_mixed(low.reshape(-1)[at]) ^ segment)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            sets = [shingles(x.as_py()) for x in batch.column(1)]
            at, key = keys(np.stack([fingerprint(x, 4) for x in sets]), np.stack([anchors(x) for x in sets]))
            ends = np.searchsorted(at, np.arange(len(sets) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key.view(np.int64)))], ["node", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            sets = [shingles(x.as_py()) for x in batch.column(1)]
            prints = np.packbits([fingerprint(x, WORDS) for x in sets], axis=1).view(np.int64)
            held = pa.array([x[:, 0].view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(prints[:, i].copy()) for i in range(WORDS)), held], ["node", "n", *PRINT, "shingles"])


def _may(a: str, b: str) -> Column:
    """Whether two members can be near copies, by their sizes and fingerprints; the same for (b, a)."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    far = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in PRINT))
    return (F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]) & (far <= FAR)


class Links:
    """Links between nodes that connect all near copies; texts has node and text, keyed has node and keys, rows may repeat."""

    def __init__(self, texts: DataFrame, keyed: DataFrame):
        filed = keyed.select("node", F.explode("keys").alias("key"))
        shared = Cut(filed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("key"), "copy-keys")
        met = Cut(filed.join(small_side(shared), "key").distinct(), "copy-met")
        sizes = Cut(met.df.groupBy("key").agg(F.count("*").alias("k")), "copy-sizes")
        central = Cut(met.df.join(small_side(sizes), "key").groupBy("node").agg(F.sum("k").alias("weight"), F.max_by("key", F.struct("k", "key")).alias("key")), "copy-weights")
        chosen = texts.join(small_side(central).select("node"), "node", "left_semi").dropDuplicates(["node"]).select("node", "text")
        self.sets = Cut(chosen.mapInArrow(tidy(_sets), f"node long, n int, {', '.join(f'{f} long' for f in PRINT)}, shingles array<long>"), "copy-sets")
        self.fullest = central.df
        self.members = Cut(met.df.join(small_side(central).select("node", "weight"), "node"), "copy-members").df
        self.prints = self.sets.df.select("node", "n", *PRINT)

    def both(self, pairs: Cut, *columns: str) -> DataFrame:
        """(x, y, a, b): the different pairs of nodes with the columns of both, as structs in no order; small pairs go to the sets, which then move for them only."""
        ends = small_side(pairs).select("x", "y", F.explode(F.array("x", "y")).alias("node"))
        held = self.sets.df.select("node", F.struct(*columns).alias("of")).join(ends, "node")
        return held.groupBy("x", "y").agg(F.min("of").alias("a"), F.max("of").alias("b"))  # two rows for each pair

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose sets are LEAST similar."""
        common, total = F.size(F.array_intersect("a.shingles", "b.shingles")), F.size("a.shingles") + F.size("b.shingles")
        return self.both(Cut(pairs.distinct(), "copy-pairs"), "shingles").where(common * LEAST[1] >= (total - common) * LEAST[0]).select("x", "y")

    def with_lead(self, rows: DataFrame) -> DataFrame:
        """Links of the rows (node, key, weight, root) with the node of most weight among those of their key, if it has another root."""
        leads = Cut(rows.groupBy("key").agg(F.max(F.struct("weight", "node", "root")).alias("lead")).select("key", F.col("lead.node").alias("lead"), F.col("lead.root").alias("apart")), "copy-leads")
        stars = Cut(rows.join(small_side(leads), "key").where("root != apart").select(F.col("lead").alias("x"), F.col("node").alias("y")).distinct(), "copy-stars")
        return Cut(self.alike(self.both(stars, "n", *PRINT).where(_may("a", "b")).select("x", "y")), "copy-links").df

    def rooted(self, found: DataFrame, members: DataFrame) -> DataFrame:
        """The members of keys with several components, with their root and the key's largest one (main) and number of members (held)."""
        settled(found.sparkSession)
        roots = Cut(components(found, "x", "y"), "copy-roots")
        rows = Cut(members.join(small_side(roots).select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "copy-rooted").df
        counts = rows.groupBy("key", "root").agg(F.count("*").alias("k"))
        main = Cut(counts.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("held"), F.count("*").alias("roots")).where("roots > 1").drop("roots"), "copy-open")
        return Cut(rows.join(small_side(main), "key"), "copy-open-members").df

    def rarest(self, open_: DataFrame) -> DataFrame:
        """(node, weight, root, n, key, at): the shingles, and their places, under which nodes of open keys meet those of other components that may be alike."""
        nodes = Cut(open_.select("node", "weight", "root").distinct(), "copy-apart")
        listed = self.sets.df.join(small_side(nodes), "node").select("node", "weight", "root", "n", F.explode("shingles").alias("key"))
        same, whole = Window.partitionBy("key"), Window.partitionBy("node")
        shared = listed.withColumns({"often": F.count("*").over(same), "low": F.min("root").over(same), "high": F.max("root").over(same)}).where("low != high").drop("low", "high")
        placed = shared.withColumn("at", F.col("n") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("often", "key")))  # a text's shingles only
        rows = Cut(placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * LEAST[0] / LEAST[1]) + 1).drop("often"), "copy-ahead").df
        met = Cut(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key"), "copy-ahead-keys")
        return Cut(rows.join(small_side(met), "key"), "copy-ahead-members").df

    def crossed(self, rows: DataFrame) -> DataFrame:
        """Pairs of different components that meet among their rarest shingles and may be alike."""
        held = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("held")).select("node", F.col("held.key").alias("keys"))  # a text's shingles only
        lists = Cut(self.prints.join(small_side(Cut(held, "copy-held")), "node"), "copy-lists")
        sketched = rows.drop("n").join(small_side(lists), "node")
        x, y = sketched.alias("x"), sketched.alias("y")
        least = F.ceil((F.col("x.n") + F.col("y.n")) * LEAST[0] / sum(LEAST))
        ahead = (F.col("x.at") <= F.col("x.n") - least + 1) & (F.col("y.at") <= F.col("y.n") - least + 1)
        once = F.col("x.key") == F.get(F.array_intersect("x.keys", "y.keys"), F.lit(0))  # both are in the one order
        apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node"))
        return x.join(y, apart & ahead & _may("x", "y") & once).select(F.col("x.node").alias("x"), F.col("y.node").alias("y"))

    def all(self) -> DataFrame:
        found = self.with_lead(self.fullest.withColumn("root", F.col("node")))
        open_ = self.rooted(found, self.members)
        for _ in range(ROUNDS):
            outside = Cut(open_.where("root != main").groupBy("node", "weight", "root").agg(F.max_by("key", F.struct("held", "key")).alias("key")), "copy-outside")
            more = self.with_lead(outside.df)
            found = found.unionByName(more)
            open_ = self.rooted(found, self.members)
            if more.count() <= FEW:
                break
        rare = self.rarest(open_)
        found = found.unionByName(self.with_lead(rare.select("node", "key", "weight", "root")))
        return found.unionByName(self.alike(self.crossed(self.rooted(found, rare.drop("root")))))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the one with the smallest key, null keys last, then with the smallest hash of its text.

    Rows are told apart by a number that is written with them, so repeated rows and keys count as the rows they are.
    """
    with passing() as keep:
        small_batches(docs.sparkSession)
        packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # no column of the input can clash
        rows = keep(Cut(docs.select(packed, F.monotonically_increasing_id().alias("at"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("node")), "copy-rows"))
        texts = rows.df.select("node", F.col(f"row.`{text}`").alias("text"))
        keyed = Cut(texts.mapInArrow(tidy(_keyed), "node long, keys array<long>"), "copy-sketches")
        settled(docs.sparkSession)
        roots = Cut(components(Links(texts, keyed.df).all(), "x", "y"), "copy-roots")
        named = rows.df.select("at", "node", F.col(f"row.`{key}`").alias("key")).join(small_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        order = F.struct(F.col("key").isNull().alias("last"), "key", "node", "at")
        first = Cut(named.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("k")).where("k > 1").select("root", F.col("first.at").alias("first")), "copy-groups")
        gone = keep(Cut(named.join(small_side(first), "root").where("at != first").select("at"), "copy-extra"))
        return rows.df.join(small_side(gone), "at", "left_anti").select("row.*")
