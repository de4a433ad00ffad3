"""Exact k-means over integer vectors, with bounds that are loosened by the norm of the whole displacement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.storage import deleted, new_path

#: Components that differ by less have squared distances of up to 4096 components within a long.
MOST = 1 << 25
_STATE = "vec_id long, x array<int>, was int, cluster int, near long, near_at int, next long, next_at int"


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exactly: in doubles where every step stays under 2^53, else in longs."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * int(most) ** 2 * x.shape[1] < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class NsBounds:
    """Bounds on distances to moving centroids, from distances that were exact in earlier rounds.

    A bound evaluated in round t is loosened by how far centroids lie now from where
    they lay in round t, the norm of their total displacement, which is at most the
    sum of the rounds' drifts. ``history`` holds the centroids of all rounds so far.
    """

    def __init__(self, history: list[np.ndarray]):
        self.now = history[-1]
        k = len(self.now)
        self.moved = np.sqrt(np.stack([((self.now - then).astype(np.float64) ** 2).sum(1) for then in history]))  # [round, centroid]
        others = np.broadcast_to(self.moved[:, None, :], (len(history), k, k)).copy()
        others[:, np.arange(k), np.arange(k)] = 0
        self.others = others.max(2)  # [round, centroid]: the farthest that any other has moved
        self.round = len(history) - 1

    def settled(self, cluster: np.ndarray, near: np.ndarray, near_at: np.ndarray, next_: np.ndarray, next_at: np.ndarray) -> np.ndarray:
        """Rows whose centroid is nearer than every other for certain; rounding is allowed for."""
        upper = np.sqrt(near.astype(np.float64)) + self.moved[near_at, cluster]
        lower = np.where(next_ < 0, np.inf, np.sqrt(np.maximum(next_, 0).astype(np.float64)) - self.others[next_at, cluster])
        return upper * (1 + 1e-9) + 1e-6 < lower * (1 - 1e-9)

    def assign(self, x: np.ndarray, state: list[np.ndarray], exact: bool) -> list[np.ndarray]:
        """The state after this round: first the stored bounds, then the exact distance to the own centroid, then all distances."""
        cluster, near, near_at, next_, next_at = (s.copy() for s in state)
        new = cluster < 0
        sure = np.zeros(len(x), bool)
        old = np.flatnonzero(~new)
        sure[old] = self.settled(*(s[old] for s in (cluster, near, near_at, next_, next_at)))
        again = old if exact else old[~sure[old]]
        near[again] = ((x[again] - self.now[cluster[again]]) ** 2).sum(1)
        near_at[again] = self.round
        sure[again] |= self.settled(*(s[again] for s in (cluster, near, near_at, next_, next_at)))
        scan = np.flatnonzero(~sure)
        if len(scan):
            d = _squared(x[scan], self.now)
            best = d.argmin(1)  # the first of equals
            rows = np.arange(len(scan))
            cluster[scan], near[scan], near_at[scan], next_at[scan] = best, d[rows, best], self.round, self.round
            d[rows, best] = np.iinfo(np.int64).max
            next_[scan] = d.min(1) if d.shape[1] > 1 else -1
        return [cluster, near, near_at, next_, next_at]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
    if np.abs(x).max(initial=0) > MOST:
        raise ValueError(f"scaled components of over {MOST}: their squared distances are beyond a long")
    return x


def _round(history: list[np.ndarray], exact: bool):
    dims = history[0].shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = NsBounds(history)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            state = [batch.column(i).to_numpy().astype(np.int64) for i in range(3, 8)]
            new = bounds.assign(x, state, exact)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            columns = [batch.column(0), pa.array(batch.column(1), pa.list_(pa.int32())), batch.column(3), *map(pa.array, new, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _moves(dims: int, k: int):
    """What a task's rows that changed cluster add to their new one and take from their old one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            was, now = (batch.column(i).to_numpy() for i in (1, 2))
            for of, sign in ((was, -1), (now, 1)):
                for c in np.unique(of[of >= 0]):
                    sums[c] += sign * x[of == c].sum(0)
                    n[c] += sign * (of == c).sum()
        found = np.flatnonzero((n != 0) | (sums != 0).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([[*sums[c].tolist(), int(n[c])] for c in found], pa.list_(pa.int64()))],
            names=["cluster", "change"])

    return run


def whole_vectors(vectors: DataFrame, dims: int, scale: int, vector: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector has exactly ``dims`` components, all finite: each times ``scale``, rounded down."""
    good = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dims)).where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:") -> DataFrame:
    """Cluster ``vectors (vec_id, embedding, ...)``: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors of another length, or with a null or non-finite component, are left out.
    Components times ``scale`` are rounded down to integers, and everything after is
    exact. The first centroids are the ``k`` vectors of least SHA-256 of seed and
    vec_id (rows that repeat a vec_id by their components, rows without one last); fewer vectors make fewer centroids. Each of ``rounds``
    rounds assigns every row to its nearest centroid, the first of equals, and moves
    non-empty centroids to the mean, rounded down; a last assignment follows. Every
    row is a vector of its own. Other columns are not read; an empty table gives an
    empty result. Components of over 2^25 after scaling are an error, since their
    squared distances would not fit in a long.

    The vectors travel with their bounds: a round is one pass without a shuffle, and
    only sums of the rows that changed cluster are gathered. The driver holds the
    centroids of all rounds, k x dims numbers each. A round's table is
    deleted once the next is written.
    """
    spark = vectors.sparkSession
    found = whole_vectors(vectors, dims, scale)
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    starts = found.orderBy(order, "x").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    history = [np.array([r.x for r in starts], np.int64)]
    k = len(starts)
    totals = [[0] * (dims + 1) for _ in range(k)]
    state = found.selectExpr("vec_id", "x", "-1 as was", "-1 as cluster", "0L as near", "0 as near_at", "0L as next", "0 as next_at")
    path = None
    for i in range(rounds + 1):
        last, path = path, new_path(spark, "vectors")
        state.mapInArrow(_round(history, exact=i == rounds), _STATE).write.parquet(path)
        if last:
            deleted(spark, last)
        state = spark.read.schema(_STATE).parquet(path)
        if i == rounds:
            break
        changed = state.where("was <> cluster").select("x", "was", "cluster").mapInArrow(_moves(dims, k), "cluster int, change array<long>")
        sums = changed.select("cluster", F.posexplode("change").alias("at", "v")).groupBy("cluster", "at").agg(F.sum("v").alias("v"))
        for c, at, v in sums.collect():  # k x (dims + 1) numbers at most
            totals[c][at] += v
        history.append(np.array([[s // t[-1] for s in t[:-1]] if t[-1] else was.tolist() for t, was in zip(totals, history[-1], strict=True)], np.int64))

    inertia = dict(state.groupBy("cluster").agg(F.sum("near")).collect())  # k rows
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashes[c]) for c in range(k)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.selectExpr("vec_id", "cluster", "near as distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance",
        "cluster_inertia", "inertia", "centroid_sha256")
