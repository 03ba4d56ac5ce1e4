"""Centroid clustering by Lloyd's rounds with Elkan's bounds, exact in integers.

A component x becomes floor(1024 * x). Every vector caches an upper bound of the distance to its centroid and a lower bound of the
distance to each of the K centroids, as they were when the cache was written. When a centroid has moved by d since then, its
lower bounds fall by d and the upper bounds of its vectors rise by d. A centroid j is left out for a vector of centroid a if the upper
bound lies under the lower bound of j, or under half the distance between a and j; else the upper bound is first
replaced by the exact distance, and j is tested again and only then measured. Bounds are rounded outwards and tests are strict,
so a centroid as near as the best is never left out and ties go to the smaller number. What is measured is measured in 64-bit integers.

The cache lies beside the vectors in a table under spark.checkpoint.dir, and rounds read it without changing it: the movement since it was
written is the distance between a centroid then and now, which is never more than the sum of its steps. Only when a round had to measure more than REFRESH of
all distances is the table written anew with the present bounds. A task sends K sums of its vectors; the driver holds the
centroids and K sums of 64 components, whatever the number of vectors.

Defined edge cases: vectors that are null, of another length, or hold null or non-finite components take no part, nor do those with a component
of 131072 or more in magnitude, as a squared distance of theirs may not fit a long; rows that repeat an id are rows of their own;
a null id takes part but begins as a centroid only after all others; equal hashes begin in the order of their components; with fewer than K
vectors there are as many centroids; a centroid without vectors stays where it is; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cut, passing, small_batches, table, tidy

SCALE, WIDTH, K, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Components stay under this, so that squared distances fit 63 bits.
LARGEST = 1 << 27
#: The share of all distances that a round may measure before the bounds are written anew; speed only.
REFRESH = 0.25
#: Relative room for rounding in bounds; far above that of 64-bit floats.
ROOM = 1e-9
STATE = "vec_id long, v array<int>, a int, up float, low array<float>"
_INT = pa.list_(pa.int32())


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of each of the rows to each of the others; both few."""
    return ((a[:, None, :].astype(np.int64) - b[None, :, :]) ** 2).sum(2)


class Bounds:
    """The test which centroids may be the nearest, for vectors whose bounds hold for the centroids ``then``."""

    def __init__(self, then: np.ndarray, now: np.ndarray):
        self.now = now.astype(np.int64)
        self.moved = np.sqrt(((self.now - then) ** 2).sum(1).astype(np.float64)) * (1 + ROOM)
        self.half = np.sqrt(gaps(self.now, self.now).astype(np.float64)) / 2 * (1 - ROOM)
        np.fill_diagonal(self.half, np.inf)  # a vector's own centroid is no rival
        self.near = self.half.min(1)
        self.measured = 0

    def _square(self, rows: np.ndarray, j: int) -> np.ndarray:
        self.measured += len(rows)
        gap = rows - self.now[j]
        return np.einsum("ij,ij->i", gap, gap)

    def assign(self, rows: np.ndarray, a: np.ndarray, up: np.ndarray, low: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, squared distance or -1 if it was not needed, upper bound, lower bounds) of each row; exact: all squared distances are given."""
        a, up = a.copy(), up.astype(np.float64) + self.moved[a]
        up += ROOM * up
        low = low.astype(np.float64)
        low = np.maximum(0, low - self.moved - ROOM * (low + self.moved))
        square = np.full(len(rows), -1, np.int64)
        rival = (up[:, None] >= low) & (up[:, None] >= self.half[a])
        rival[np.arange(len(rows)), a] = False
        open_ = rival.any(1) & (up >= self.near[a])
        for j in range(len(self.now)):
            own = np.flatnonzero((a == j) & (open_ | exact))
            if len(own):
                square[own] = self._square(rows[own], j)
                up[own] = np.sqrt(square[own].astype(np.float64)) * (1 + ROOM)
                low[own, j] = np.sqrt(square[own].astype(np.float64)) * (1 - ROOM)
        first = a.copy()
        rival &= open_[:, None] & (up[:, None] >= low) & (up[:, None] >= self.half[first])
        for j in range(len(self.now)):
            rows_of = np.flatnonzero(rival[:, j])
            rows_of = rows_of[(up[rows_of] >= low[rows_of, j]) & (up[rows_of] >= np.where(a[rows_of] == j, np.inf, self.half[a[rows_of], j]))] if len(rows_of) else rows_of
            if not len(rows_of):
                continue
            found = self._square(rows[rows_of], j)
            low[rows_of, j] = np.sqrt(found.astype(np.float64)) * (1 - ROOM)
            better = (found < square[rows_of]) | ((found == square[rows_of]) & (j < a[rows_of]))
            won = rows_of[better]
            a[won], square[won] = j, found[better]
            up[won] = np.sqrt(square[won].astype(np.float64)) * (1 + ROOM)
        return a, square, up, low


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), width)


def _each(bounds: Bounds, batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[tuple]:
    """(batch, rows, assign()'s result) of each batch of the state."""
    for batch in batches:
        rows = _matrix(batch.column(1), WIDTH, np.int64)
        yield batch, rows, bounds.assign(rows, np.array(batch.column(2), np.int32), np.array(batch.column(3)), _matrix(batch.column(4), len(bounds.now), np.float32), exact)


def _rewritten(then: np.ndarray, now: np.ndarray) -> Callable:
    """The state with the bounds that hold for the present centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, (a, _, up, low) in _each(Bounds(then, now), batches, False):
            up, low = np.nextafter(up.astype(np.float32), np.float32(np.inf)), np.nextafter(low.astype(np.float32), np.float32(0))
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(now))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(_INT), pa.array(a), pa.array(up), pa.ListArray.from_arrays(ends, pa.array(low.reshape(-1)))], ["vec_id", "v", "a", "up", "low"])

    return tidy(run)


def _summed(then: np.ndarray, now: np.ndarray) -> Callable:
    """(cluster, i, total): a task's sums of its vectors by component, the number of vectors as component -1, and what was measured as cluster -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, total, n = Bounds(then, now), np.zeros((len(now), WIDTH), np.int64), np.zeros(len(now), np.int64)
        for _, rows, (a, *_) in _each(bounds, batches, False):
            for j in np.unique(a).tolist():
                total[j] += rows[a == j].sum(0)
            n += np.bincount(a, minlength=len(now))
        cluster, i = np.divmod(np.arange(len(now) * (WIDTH + 1)), WIDTH + 1)
        values = np.concatenate([total, n[:, None]], 1).reshape(-1)
        columns = np.append(cluster, -1).astype(np.int32), np.append(np.where(i == WIDTH, -1, i), -1).astype(np.int32), np.append(values, bounds.measured)
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["cluster", "i", "total"])

    return tidy(run)


def _placed(then: np.ndarray, now: np.ndarray) -> Callable:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, (a, square, *_) in _each(Bounds(then, now), batches, True):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(square)], ["vec_id", "cluster", "distance"])

    return tidy(run)


def started(vectors: DataFrame, key: str, vector: str) -> Cut:
    """The vectors that take part, in integers, with bounds that say nothing yet."""
    x = F.col(f"`{vector}`")
    sound = x.isNotNull() & (F.size(x) == WIDTH) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(SCALE * c.cast("double")) < LARGEST))
    whole = F.transform(x, lambda c: F.floor(SCALE * c.cast("double")).cast("int"))
    return Cut(vectors.where(sound).select(F.col(f"`{key}`").cast("long").alias("vec_id"), whole.alias("v")), "vectors")


def first_centroids(rows: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    hashed = rows.select(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vec_id", "v")
    found = hashed.orderBy(F.asc_nulls_last("h"), "vec_id", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in found], np.int64).reshape(len(found), WIDTH)


def means(sums: DataFrame, before: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(centroids: floors of exact means, empty ones as before; vectors; distances measured). The driver gets WIDTH + 1 numbers a centroid."""
    total: dict[tuple[int, int], int] = {(r.cluster, r.i): int(r.total) for r in sums.groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    after = before.copy()
    for j in range(len(before)):
        if n := total.get((j, -1), 0):
            after[j] = [total[j, i] // n for i in range(WIDTH)]
    return after, sum(total.get((j, -1), 0) for j in range(len(before))), total.get((-1, -1), 0)


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, the final centroids)."""
    small_batches(vectors.sparkSession)
    with passing() as keep:
        plain = started(vectors, key, vector)
        centroids = first_centroids(plain.df, k)
        if not len(centroids):
            return keep(Cut(plain.df.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "clustered")).df, centroids
        unknown = [F.lit(0).alias("a"), F.lit(float("inf")).cast("float").alias("up"), F.array_repeat(F.lit(0.0).cast("float"), len(centroids)).alias("low")]
        then = centroids
        state = Cut(plain.df.select("vec_id", "v", *unknown).mapInArrow(_rewritten(then, centroids), STATE), "cluster-bounds")
        plain.drop()
        for _ in range(rounds):
            sums = state.df.mapInArrow(_summed(then, centroids), "cluster int, i int, total long")
            after, n, measured = means(sums, centroids)
            if (after == centroids).all():
                break  # further rounds would change nothing
            if measured > REFRESH * n * len(centroids):
                newer = Cut(state.df.mapInArrow(_rewritten(then, after), STATE), "cluster-bounds")
                state.drop()
                state, then = newer, after
            centroids = after
        return keep(Cut(state.df.mapInArrow(_placed(then, centroids), "vec_id long, cluster int, distance long"), "clustered")).df, centroids


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = clustered(table(spark, sf_dir, "embeddings"))
    held = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row per centroid
    own = F.array(*(F.lit(held.get(j, 0)).cast("long") for j in range(len(centroids))), F.lit(0).cast("long"))
    digest = F.array(*(F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()), F.lit(""))
    total = F.lit(sum(held.values())).cast("long")
    return rows.select("vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), total.alias("inertia"), F.get(digest, F.col("cluster")).alias("centroid_sha256"))


def _sql() -> str:
    square = "list_dot_product(e, e) - 2 * list_dot_product(e, c) + list_dot_product(c, c)"
    parts = [f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, [floor({SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id, e) - 1 AS j, e AS c FROM v QUALIFY j < {K}
)"""]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, any_value(e) AS e, min(CAST({square} AS BIGINT) * {K} + j) AS best FROM v, c{r} GROUP BY n)")
        if r < ROUNDS:
            parts.append(f"""s{r} AS (SELECT best % {K} AS j, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}),
m{r} AS (SELECT j, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM s{r} GROUP BY j, i),
f{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM m{r} GROUP BY j),
c{r + 1} AS MATERIALIZED (SELECT j, coalesce(f.c, o.c) AS c FROM c{r} o LEFT JOIN f{r} f USING (j))""")
    last = f"""d AS (SELECT vec_id, best % {K} AS j, best // {K} AS distance FROM a{ROUNDS} JOIN v USING (n))
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in c], 'string_agg', ',')) AS centroid_sha256
FROM d JOIN c{ROUNDS} USING (j)"""
    return ", ".join(parts) + ", " + last


QUERIES = {"op11_clusters": op11_clusters}
ORACLES = {"op11_clusters": _sql()}
