"""Exact top-k search by inner product with pivot-table elimination.

A component x becomes floor(1024 * x). Every vector carries its distances to PIVOTS pivots (chosen
farthest-first from a sample of SAMPLE rows). By the triangle inequality the largest difference
between a query's and a candidate's entries bounds their distance from below, and with both norms that
bounds the inner product from above.

A query's floor is its k-th best score among the sample's rows, a bound that every part of the search shares from
the start. Candidates are grouped by their nearest pivot; of a group, the ranges of its entries give one bound for all its
rows, and a query only visits groups whose bound reaches its floor. Groups are cut into cells of a bounded number of
rows, queries into blocks that follow the order of their own nearest pivots, and only cells that a block visits travel to it. In a cell
candidates are evaluated in the order of their bounds, in growing batches, until the bound falls below the floor or the k-th best
score: no candidate left can enter, ties included. The k best of all cells are the result.

Defined edge cases: vectors that are null or hold null or non-finite components, and rows without an id,
take no part; rows that repeat an id are rows of their own, as queries and as candidates; ties go to the smaller id;
vectors only meet vectors of their own length; fewer than k candidates give fewer rows; an empty table
gives an empty result; extra columns are ignored. Scores are exact while they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Cut, small_batches, small_side, table, tidy

SCALE, K, EVERY = 1024, 10, 100
PIVOTS, SAMPLE = 64, 2048
#: Most candidates and queries of a cell, about.
CANDIDATES, QUERY_BLOCK = 32768, 16384


def pivots(sample: np.ndarray) -> np.ndarray:
    """Farthest-first: each pivot is the sample's row farthest from those before it; equal rows give one."""
    if not len(sample):
        return sample
    at, chosen = int(np.argmax((sample * sample).sum(1))), []
    gap = np.full(len(sample), np.inf)
    while len(chosen) < PIVOTS and gap[at] > 0:
        chosen.append(at)
        gap = np.minimum(gap, ((sample - sample[at]) ** 2).sum(1))
        at = int(np.argmax(gap))
    return sample[chosen]


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Distances of integer rows to the pivots, in blocks of bounded size."""
    out = np.empty((len(rows), max(1, len(to))), np.float32)
    out[:, 0] = 0
    for i, p in enumerate(to):
        out[:, i] = np.sqrt(((rows - p) ** 2).sum(1, dtype=np.float64))
    return out


def _limit(square: np.ndarray | float, others: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most an inner product can be, from squared norms and a lower bound of the distance; rounding never excludes."""
    low = np.maximum(0, low * (1 - 1e-6) - 1e-6 * np.sqrt(square + others))  # entries are rounded to 32 bits
    bound = (square + others - low * low) / 2
    return bound + 1 + 1e-9 * (square + others)


def best(queries: np.ndarray, query_rows: np.ndarray, query_far: np.ndarray, floors: np.ndarray, rows: np.ndarray, row_numbers: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int = K) -> tuple[list, int]:
    """([(query row, vec_id, score)], candidates evaluated): of each query's k best rows those that reach its floor."""
    exact = float(max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))) ** 2 * max(1, rows.shape[1]) < 2**52
    kind = np.float64 if exact else np.int64
    queries, rows = queries.astype(kind), rows.astype(kind)
    square = (rows.astype(np.float64) ** 2).sum(1)
    out, evaluated = [], 0
    for q, own, d, floor in zip(queries, query_rows.tolist(), query_far, floors.tolist(), strict=True):
        bound = _limit(float((q.astype(np.float64) ** 2).sum()), square, np.abs(far - d).max(1).astype(np.float64))
        open_ = np.flatnonzero((bound >= floor) & (row_numbers != own))
        order = open_[np.argsort(-bound[open_], kind="stable")]
        top_score, top_id, at, step = np.empty(0, kind), np.empty(0, np.int64), 0, 4 * k
        while at < len(order):
            part = order[at : at + step]
            if len(top_score) == k and bound[part[0]] < top_score[-1]:
                break
            score, found = np.concatenate([top_score, rows[part] @ q]), np.concatenate([top_id, ids[part]])
            keep = np.lexsort((found, -score))[:k]
            top_score, top_id = score[keep], found[keep]
            evaluated += len(part)
            at, step = at + step, step * 2
        out += [(own, int(i), int(s)) for i, s in zip(top_id, top_score, strict=True) if s >= floor]
    return out, evaluated


def _rows(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _cell(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    found: list = []
    if len(queries) and len(rows):
        stacked = lambda x: np.stack(x["far"].to_list())
        found = best(_rows(queries.raw, np.int64), queries.n.to_numpy(), stacked(queries), queries.floor.to_numpy(), _rows(rows.raw, np.int64), rows.n.to_numpy(), rows.id.to_numpy(), stacked(rows))[0]
    return pd.DataFrame(found, columns=["n", "vec_id", "score"], dtype="int64")


ROW = "n long, id long, dim int, g int, square double, raw binary, far array<float>"


class Table:
    """The rows with their pivot distances, and what the driver knows of them: the sample, and the groups' ranges.

    The driver holds SAMPLE vectors and the groups: at most PIVOTS for each length that the sample has, one for each other length.
    """

    def __init__(self, vectors: DataFrame, key: str, vector: str):
        small_batches(vectors.sparkSession)
        whole = F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")))
        sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        clean = Cut(vectors.where(sound).select(F.monotonically_increasing_id().alias("n"), F.col(key).cast("long").alias("id"), whole.alias("v")), "vectors").df
        hashed = clean.select("n", "v", F.xxhash64("n").alias("h"))
        last = hashed.select("h", "n").orderBy("h", "n").limit(SAMPLE).agg(F.max(F.struct("h", "n")).alias("last")).first()["last"]
        picked = hashed.where(F.struct("h", "n") <= F.struct(F.lit(last.h).cast("long"), F.lit(last.n).cast("long"))).orderBy("h", "n").collect() if last else []  # SAMPLE rows at most
        by_size: dict[int, list] = {}
        for row in picked:
            by_size.setdefault(len(row.v), []).append(row)
        self.sample = {size: (np.array([r.n for r in x], np.int64), np.array([r.v for r in x], np.float64).reshape(len(x), size)) for size, x in by_size.items()}
        chosen = {size: pivots(x) for size, (_, x) in self.sample.items()}

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.array([len(v) for v in batch.column(2)])
                for size in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == size))
                    rows = np.array(part.column(2).flatten(), np.int64).reshape(part.num_rows, size)
                    far = distances(rows, chosen.get(size, np.empty((0, size))))  # a length that the sample lacks has no pivots: its bound is the norms'
                    ends = np.arange(part.num_rows + 1, dtype=np.int32) * far.shape[1]
                    raw = rows.tobytes()
                    raws = pa.array([raw[k : k + 8 * size] for k in range(0, 8 * size * part.num_rows, 8 * size)] if size else [b""] * part.num_rows, pa.binary())
                    square = (rows.astype(np.float64) ** 2).sum(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([size] * part.num_rows, pa.int32()), pa.array(far.argmin(1).astype(np.int32)), pa.array(square), raws, pa.ListArray.from_arrays(pa.array(ends), pa.array(far.reshape(-1)))], ["n", "id", "dim", "g", "square", "raw", "far"])

        self.rows = Cut(clean.mapInArrow(tidy(measured), ROW), "pivoted").df
        self.asked = self.rows.where(F.col("id") % EVERY == 0)
        ends = [f(F.get("far", F.lit(i))).alias(f"{name}{i}") for i in range(PIVOTS) for name, f in (("lo", F.min), ("hi", F.max))]
        groups = self.rows.groupBy("dim", "g").agg(F.count("*").alias("n"), F.sum((F.col("id") % EVERY == 0).cast("long")).alias("asked"), F.max("square").alias("square"), *ends)
        self.groups = groups.orderBy("dim", "g").collect()


def floors(sample: dict[int, tuple[np.ndarray, np.ndarray]], size: int, numbers: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each query's K-th best score among the sample's rows of its length, a score that the result reaches."""
    held, vectors = sample.get(size, (np.empty(0, np.int64), np.empty((0, size))))
    if len(held) <= K:
        return np.full(len(rows), -np.inf)
    scores = rows.astype(np.float64) @ vectors.T
    scores[numbers[:, None] == held[None, :]] = -np.inf
    top = np.partition(scores, len(held) - K, axis=1)[:, len(held) - K]
    return np.where(np.abs(top) < 2**52, top, -np.inf)


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the K best for every row whose id EVERY divides, against all other rows."""
    held = Table(vectors, key, vector)
    blocks, before, cells = {}, 0, {}
    for r in held.groups:  # queries are numbered in the order of their groups; a block is a stretch of them
        blocks[r.dim, r.g] = (before, r.asked)
        before += r.asked
        cells[r.dim, r.g] = ceil(r.n / CANDIDATES)
    by_size: dict[int, list] = {}
    for r in held.groups:
        width = min(PIVOTS, sum(r[f"lo{i}"] is not None for i in range(PIVOTS)))
        by_size.setdefault(r.dim, []).append((r.g, r.square, [r[f"lo{i}"] for i in range(width)], [r[f"hi{i}"] for i in range(width)]))
    ranges = {size: tuple(np.array(c, t) for c, t in zip(zip(*x, strict=True), (np.int32, np.float64, np.float64, np.float64), strict=True)) for size, x in by_size.items()}
    sample = held.sample

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and cell that may hold a row above its floor."""
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sizes = np.array(batch.column(2))
                for size in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == size))
                    numbers = np.array(part.column(0))
                    rows = np.frombuffer(b"".join(part.column(5).to_pylist()), np.int64).reshape(part.num_rows, size)
                    far = np.array(part.column(6).flatten(), np.float64).reshape(part.num_rows, -1)
                    least, square = floors(sample, size, numbers, rows), np.array(part.column(4))
                    g, most, lo, hi = ranges[size]
                    own, group = [], []
                    for k in range(part.num_rows):
                        gap = np.maximum(np.maximum(lo - far[k], far[k] - hi), 0).max(1)
                        open_ = g[_limit(square[k], most, gap) >= least[k]]
                        for x in open_.tolist():
                            own += [k] * cells[size, x]
                            group += [(x, c) for c in range(cells[size, x])]
                    base, n = zip(*(blocks[size, x] for x in np.array(part.column(3)).tolist()), strict=True)
                    share = (numbers * 0x9E3779B1 % (1 << 32)) / (1 << 32)
                    block = ((np.array(base) + share * np.array(n)) // QUERY_BLOCK).astype(np.int32)
                    taken = part.take(pa.array(own, pa.int64()))
                    to, cell = (pa.array([x[i] for x in group], pa.int32()) for i in range(2))
                    yield pa.RecordBatch.from_arrays([*taken.columns[:3], to, *taken.columns[4:], pa.array(least[own], pa.float64()), cell, pa.array(block[own], pa.int32())], ["n", "id", "dim", "g", "square", "raw", "far", "floor", "cell", "block"])

    left = Cut(held.asked.mapInArrow(tidy(routed), f"{ROW}, floor double, cell int, block int"), "routed").df
    visited = Cut(left.select("dim", "g", "cell", "block").distinct(), "visited")
    several = [(*at, n) for at, n in cells.items() if n > 1]

    def count(rows: list) -> Column:
        found = F.lit(1)
        for size, g, n in rows:
            found = F.when((F.col("dim") == size) & (F.col("g") == g), n).otherwise(found)
        return found

    right = held.rows.withColumn("cell", F.pmod(F.xxhash64("n"), count(several)).cast("int"))
    right = right.join(small_side(visited), ["dim", "g", "cell"])
    at = ("dim", "g", "cell", "block")
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_cell, "n long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= K)
    return ranked.join(held.asked.select("n", F.col("id").alias("query_id")), "n").select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_topk": op9_topk}
ORACLES = {
    "op9_topk": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.n <> c.n
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
}
