"""Centroid clustering of integer vectors with Hamerly's bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

#: Components stop here, so that squared distances of 64 components fit 63 bits.
MOST = 1 << 27
_STATE = "vec_id long, q binary, cluster int, upper double, lower double, distance long"
#: Sums, roots and drifts in double precision are off by far less than this share.
_SLACK = 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """One assignment round: ``drift`` is how far each centroid moved since the bounds were kept, ``far`` half the distance to its nearest other one.

    A vector whose upper bound is strictly below its lower bound, or below ``far`` of its centroid, keeps its centroid. Otherwise the
    upper bound is made exact, and if that doesn't settle it, all centroids are scanned in integers; ties go to the smaller number.
    """

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.c = centroids
        k = len(centroids)
        self.drift = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(float)) * (1 + _SLACK)
        between = np.array([np.sqrt(squared(centroids, np.broadcast_to(x, centroids.shape)).astype(float)) for x in centroids])
        np.fill_diagonal(between, np.inf)
        self.far = between.min(1) / 2 * (1 - _SLACK)
        self.scanned = 0

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New ``(cluster, upper, lower)``; a cluster of -1 has no bounds yet."""
        cluster, known = cluster.copy(), cluster >= 0
        upper = np.where(known, upper + self.drift[cluster], np.inf) * (1 + _SLACK)
        others = self._largest_other(cluster)
        lower = np.where(known, np.maximum(lower - others, 0) * (1 - _SLACK), 0.0)
        limit = np.maximum(lower, np.where(known, self.far[cluster], 0.0))
        open_ = np.flatnonzero(upper >= limit)
        tight = open_[known[open_]]
        upper[tight] = np.sqrt(squared(x[tight], self.c[cluster[tight]]).astype(float)) * (1 + _SLACK)
        rest = open_[upper[open_] >= limit[open_]]
        self.scanned += len(rest)
        for at in range(0, len(rest), 4096):
            i = rest[at : at + 4096]
            d = np.stack([squared(x[i], c[None, :]) for c in self.c], axis=1)
            best = d.argmin(1)  # the first of equal ones
            cluster[i] = best
            upper[i] = np.sqrt(d[np.arange(len(i)), best].astype(float)) * (1 + _SLACK)
            d[np.arange(len(i)), best] = np.iinfo(np.int64).max
            lower[i] = np.sqrt(d.min(1).astype(float)) * (1 - _SLACK) if len(self.c) > 1 else np.inf
        return cluster, upper, lower

    def _largest_other(self, cluster: np.ndarray) -> np.ndarray:
        """The largest drift of any centroid but a vector's own."""
        if len(self.c) < 2:
            return np.zeros(len(cluster))
        order = np.argsort(self.drift)
        return np.where(cluster == order[-1], self.drift[order[-2]], self.drift[order[-1]])


def _whole(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """``(vec_id, q)`` of the vectors kept, q as 64-bit integers."""
    v = F.col("embedding")
    inf = F.lit(float("inf"))
    ok = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf))
    limit = F.lit(float(MOST))
    whole = F.transform(v, lambda x: F.floor(F.greatest(-limit, F.least(limit, x.cast("double") * scale))))
    return rows.where(F.coalesce(ok, F.lit(False))).select("vec_id", whole.alias("q"))


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector of ``rows(vec_id, embedding)`` that is kept.

    Kept are vectors with ``dims`` components, none null or non-finite; a component x becomes ``floor(scale * x)``, and one beyond ``MOST`` in size counts as
    that. The first centroids are the k kept vectors with the smallest SHA-256 of ``seed:vec_id`` (a null vec_id as nothing; equal ones by their components); with fewer
    vectors there are fewer centroids, without any no rows. Each round assigns and then takes the floor of each cluster's mean; a last assignment
    follows. Repeated vec_ids are vectors of their own. Sums beyond 63 bits count as the largest long. Other columns are ignored.

    Between rounds a vector keeps its upper bound and its lower bound to the second nearest centroid, in a table that each round rewrites; nothing is shuffled but
    each task's sums by cluster. Rounds loosen the bounds by the centroids' drift, and only vectors they leave open are scanned, in
    integers. The k centroids are all that the driver holds.
    """
    spark = rows.sparkSession
    small_batches(spark, 10_000)
    kept = _whole(rows, dims, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["q"] for r in kept.orderBy(order, "q").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    now, before, state = np.array(first, np.int64), None, None

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = np.asarray(b.column("q").flatten(), np.int64).reshape(-1, dims)
            yield step(b.column("vec_id"), q, np.full(len(q), -1, np.int64), np.full(len(q), np.inf), np.zeros(len(q)), Bounds(now, None), rounds == 0)

    def step(ids: pa.Array, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, bounds: Bounds, last: bool) -> pa.RecordBatch:
        cluster, upper, lower = bounds.assign(q, cluster, upper, lower)
        distance = pa.array(squared(q, bounds.c[cluster])) if last else pa.nulls(len(q), pa.int64())
        held = pa.array([x.tobytes() for x in q.astype("<i4")], pa.binary())
        return pa.record_batch({"vec_id": ids.cast(pa.int64()), "q": held, "cluster": pa.array(cluster.astype(np.int32)), "upper": pa.array(upper), "lower": pa.array(lower), "distance": distance})

    def again(now: np.ndarray, before: np.ndarray, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bounds = Bounds(now, before)
            for b in batches:
                yield step(b.column("vec_id"), _vectors(b, dims), np.asarray(b.column("cluster"), np.int64), np.asarray(b.column("upper")), np.asarray(b.column("lower")), bounds, last)

        return run

    for k_round in range(rounds + 1):
        old = state
        state = written(kept.mapInArrow(begin, _STATE) if old is None else old.mapInArrow(again(now, before, k_round == rounds), _STATE), "bounds")
        if old is not None:
            discard(old)
        if k_round < rounds:
            before, now = now, _means(state, now, dims)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by = written(state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")), "inertia")
    total = by.agg(F.least(F.sum("sum"), most).cast("long").alias("inertia"))
    named = by.select("cluster", F.least("sum", most).cast("long").alias("cluster_inertia"), F.element_at(F.array(*map(F.lit, digest)), F.col("cluster") + 1).alias("centroid_sha256"))
    named = named.crossJoin(F.broadcast(total))
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _vectors(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("q").to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def _means(state: DataFrame, now: np.ndarray, dims: int) -> np.ndarray:
    """Each cluster's mean, rounded down; an empty one keeps its centroid. Tasks send one row a cluster, sums meet by component."""
    k = len(now)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            q, cluster = _vectors(b, dims), np.asarray(b.column("cluster"))
            n += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster).tolist():
                total[c] += q[cluster == c].sum(0)
        some = np.flatnonzero(n)
        yield pa.record_batch({"cluster": pa.array(some.astype(np.int32)), "n": pa.array(n[some]), "sums": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

    parts = state.select("q", "cluster").mapInArrow(partial, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    out = now.copy()
    for r in each.collect():  # at most k times dims rows
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out
