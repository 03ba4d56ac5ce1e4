"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into five blocks. Two fingerprints that differ in at most three bits agree in
at least two blocks, whichever they are; the bits of the other three blocks form two segments, of which one
differs in at most one bit. Each segment is read as a word of the perfect (23, 12) Golay code (shortened: its
high bits are zero): every word lies within three errors of exactly one codeword. ``home(x)`` is that
codeword's 12-bit index and ``near(x)`` holds the homes of x and of all words one error away, one to six
indices; if x and y differ in at most two bits, near(x) and near(y) share an index.

So for each of the ten pairs of blocks and both segments, a fingerprint is filed under the blocks' bits and each
index near the segment: about a hundred keys of 37 or 38 bits, of which unrelated fingerprints hardly share any before
there are 10^9 of them, so that what meets grows with the near copies and not with the square of the table. Every
pair within three bits meets under a key, and the meeting is verified on all 64 bits.

Keys of one fingerprint are dropped. Keys of up to DIRECT are joined directly. Fuller keys are dealt out in blocks:
each cell of at most about BLOCK x BLOCK fingerprints compares them and returns only a spanning forest of
its links, so that large groups of near copies neither meet in one task nor return all their pairs.
Copies of a fingerprint are one node throughout.

Defined edge cases: null and empty texts have fingerprint zero and are linked like any other; fewer than
three words are one shingle; repeated rows return one row each; a null doc_id returns a row but never
names a component unless all of its component are null; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, passing, small_batches, small_side, table, tidy
from .components import components

SHINGLE, SEED, BITS = 3, 42, 3

#: The generator polynomial of the (23, 12) code, highest power first.
GENERATOR, LENGTH, CHECKS = 0b110001110101, 23, 11
#: Bits of the five blocks, from the top.
BLOCKS = (13, 13, 13, 13, 12)
#: A key with more fingerprints is dealt out in cells.
DIRECT = 64
#: Fingerprints on either side of a cell, about.
BLOCK = 512
#: Fingerprints that one task files under their keys, about.
SPREAD = 16384


def counted(rows: np.ndarray) -> np.ndarray:
    """How many rows of bytes have each bit set."""
    total = np.zeros(8 * rows.shape[1], np.int64)
    bits = np.unpackbits(rows, axis=1)
    for at in range(0, len(bits), 255):  # a byte holds the sum of so many rows
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None) -> int:
    """Unsigned; a bit is set if it is set in over half the shingles' hashes."""
    words = text.encode().lower().split() if text else []  # bytes lower only A-Z and split at exactly the contract's separators
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts = np.zeros(64, np.int64)
    n = len(words) - SHINGLE + 1
    for at in range(0, n, 8192):  # bounded memory on very long texts
        part = words[at : at + 8192 + SHINGLE - 1]
        hashes = [xxhash.xxh64_digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(SHINGLE)), strict=False)]
        counts += counted(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, fp long").withColumnRenamed("key", key)


def _syndrome(word: int) -> int:
    for i in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECKS)
    return word


class Golay:
    """Decoding tables, computed from the generator once per process."""

    _one: Golay | None = None

    def __init__(self) -> None:
        single = np.array([_syndrome(1 << i) for i in range(LENGTH)], np.int32)

        def folded(bits: np.ndarray) -> np.ndarray:
            out = np.zeros(1 << len(bits), np.int32)
            for i, s in enumerate(bits):
                out[1 << i : 2 << i] = out[: 1 << i] ^ s
            return out

        self.low, self.high = folded(single[:12]), folded(single[12:])
        self.error = np.zeros(1 << CHECKS, np.int32)
        for weight in range(4):
            for at in combinations(range(LENGTH), weight):
                pattern = sum(1 << i for i in at)
                self.error[_syndrome(pattern)] = pattern

    @classmethod
    def get(cls) -> Golay:
        cls._one = cls._one or cls()
        return cls._one

    def home(self, word: np.ndarray) -> np.ndarray:
        """The index of the codeword within three errors."""
        return (word ^ self.error[self.low[word & 0xFFF] ^ self.high[word >> 12]]) >> CHECKS

    def near(self, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): the homes of each word and of the words one error away, each once a row."""
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
        homes = np.sort(self.home(word[:, None] ^ flips), axis=1)
        fresh = np.concatenate([np.ones((len(word), 1), bool), homes[:, 1:] != homes[:, :-1]], axis=1)
        return np.nonzero(fresh)[0], homes[fresh]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of unsigned fingerprints: number of the pair of blocks and segment, bits of the blocks, codeword index."""
    golay, at, blocks = Golay.get(), 64, []
    for bits in BLOCKS:
        at -= bits
        blocks.append((fp >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1))
    rows, found = [], []
    for k, (a, b) in enumerate(combinations(range(len(BLOCKS)), 2)):
        held = blocks[a] << BLOCKS[b] | blocks[b]
        rest, width = np.zeros(len(fp), np.int64), 0
        for i in set(range(len(BLOCKS))) - {a, b}:
            rest, width = rest << BLOCKS[i] | blocks[i], width + BLOCKS[i]
        half = width // 2
        for s, (word, bits) in enumerate(((rest >> half, width - half), (rest & ((1 << half) - 1), half))):
            row, index = golay.near(word.astype(np.int32), bits)
            rows.append(row)
            found.append((np.int64(2 * k + s) << 26 | held[row]) << 12 | index)
    return np.concatenate(rows), np.concatenate(found)


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy()
        for at in range(0, len(every), 2048):
            fp = every[at : at + 2048]
            row, key = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def _forest(cell: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the cell's two blocks, which may be the same."""
    x, y = (np.unique(cell.loc[cell["slot"] == cell[c], "fp"].to_numpy()) for c in ("i", "j"))
    nodes = np.union1d(x, y)
    top = np.arange(len(nodes))
    i, j = np.nonzero(np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]) <= BITS)
    left, right = np.searchsorted(nodes, x)[i], np.searchsorted(nodes, y)[j]
    kept = []
    for p, q in zip(left.tolist(), right.tolist(), strict=True):
        r, s = p, q
        while top[r] != r:
            top[r] = r = top[top[r]]
        while top[s] != s:
            top[s] = s = top[top[s]]
        if r != s:
            top[max(r, s)] = min(r, s)
            kept.append((nodes[p], nodes[q]))
    return pd.DataFrame(kept, columns=["x", "y"], dtype="int64")


def links(nodes: DataFrame) -> DataFrame:
    """(x, y): links between distinct fingerprints that connect all pairs within BITS bits."""
    spread = max(nodes.sparkSession.sparkContext.defaultParallelism, ceil(nodes.count() / SPREAD))
    filed = nodes.select("fp").repartition(spread, "fp").mapInArrow(tidy(_filed), "key long, fp long")  # a row becomes a hundred
    shared = Cut(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "golay-shared")
    met = Cut(filed.join(small_side(shared), "key"), "golay-met")

    few = met.df.where(F.col("n") <= DIRECT)
    x, y = few.select("key", F.col("fp").alias("x")), few.select("key", F.col("fp").alias("y"))
    close = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= BITS)
    direct = x.join(y, (x.key == y.key) & close).select("x", "y").distinct()

    many = met.df.where(F.col("n") > DIRECT).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    slot = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = many.select("key", "fp", slot.alias("slot"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", "fp", "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))
    return direct.unionByName(cells.groupBy("key", "i", "j").applyInPandas(_forest, "x long, y long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for every row."""
    with passing() as keep:
        small_batches(docs.sparkSession)
        found = keep(Cut(fingerprints(docs, key, text), "fingerprints"))
        nodes = Cut(found.df.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
        roots = Cut(components(links(nodes.df), "x", "y"), "roots")
        low = Cut(nodes.df.join(roots.df, F.col("fp") == F.col("node")).groupBy("root").agg(F.min("first").alias("low")), "lowest")
        linked = roots.df.join(low.df, "root").select(F.col("node").alias("fp"), "low")
        named = keep(Cut(nodes.df.join(linked, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id")), "named"))
        return found.df.join(small_side(named), "fp").select(key, "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
