"""Centroid clustering by exponion search on integer vectors.

Each vector carries its centroid, an upper bound of its distance to it and a lower bound of that to any other. After the centroids
have moved, bounds move by as much; a vector whose upper bound is below its lower bound, or below half the distance to the centroid next to
its own, stays. Else its distance is measured, and if it still may move, only the centroids inside a ball around its own are
scanned: radius twice the distance plus that to the next centroid, found in the sorted list of distances from its own centroid. The ball
holds the nearest centroid, all that tie with it and the second nearest, as its radius counts as inside. Bounds are doubles rounded
to the safe side, comparisons that let a vector stay are strict, and distances are exact longs.

Each round writes vectors and bounds to the shared scratch folder, with a row of sums for each task and cluster beside them, so an update
gathers no vectors; the driver holds the centroids.

Defined results: vectors that are null, of another length or that hold a null or non-finite component have no row. Components are
floor(scale * x); ones too large for distances in a long raise. Start vectors are the first by the hash of their id, null ids
last, equal ids by their components. Fewer vectors than ``k`` make as many centroids. Repeated rows each count. Ties go to the smaller
cluster number, empty clusters keep their centroid. Only the two named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import materialize, release
from .vectors import above, below, floors, squared, summed, total_sums, usable

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


def moved_bounds(cluster, upper, lower, old: np.ndarray, new: np.ndarray):
    """Bounds after the centroids have moved from ``old`` to ``new``."""
    step = above(_root(((new - old) ** 2).sum(1)))
    most = np.sort(step)[::-1]
    other = np.where(step[cluster] == most[0], most[1] if len(most) > 1 else 0.0, most[0])
    return above(upper + step[cluster]), below(lower - other)


def exponion(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, scanned: list | None = None):
    """(cluster, upper, lower) of each vector for these centroids. ``scanned`` gets the number of distances that were measured."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    between = squared(centroids, centroids)
    count = 0
    for a in np.unique(cluster).tolist():
        others = np.delete(np.arange(len(centroids)), a)
        others = others[np.argsort(between[a, others], kind="stable")]
        away = _root(between[a, others])
        next_low, next_high = (below(away[0]), above(away[0])) if len(others) else (np.inf, np.inf)
        at = np.flatnonzero(cluster == a)
        at = at[~(upper[at] < np.maximum(next_low / 2, lower[at]))]
        own = squared(q[at], centroids[a : a + 1])[:, 0]
        count += at.size
        upper[at] = above(_root(own))
        open_ = ~(upper[at] < np.maximum(next_low / 2, lower[at]))
        at = at[open_]
        if not at.size or not len(others):
            continue
        inside = np.searchsorted(below(away), above(2 * upper[at] + next_high), side="right")
        for m in np.unique(inside):
            some = at[inside == m]
            near = np.sort(np.append(others[:m], a))  # by number, so that the first least is the smallest
            d = squared(q[some], centroids[near])
            count += d.size
            best = d.argmin(1)
            rows = np.arange(some.size)
            upper[some] = above(_root(d[rows, best]))
            cluster[some] = near[best]
            d[rows, best] = np.iinfo(np.int64).max
            lower[some] = below(_root(d.min(1)))
    if scanned is not None:
        scanned.append(count)
    return cluster, upper, lower


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", seed: str = "1:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each usable vector."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).where(usable("vec", dims)).withColumn("vec", F.col("vec").cast("array<double>"))
    mark = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(mark.asc_nulls_last(), "vec").limit(k).toArrow()
    cents = floors(first["vec"], scale, dims)
    kind = kept.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, q array<int>, cluster int, upper double, lower double, distance bigint, n bigint, sums array<bigint>"

    def assign(centroids, before, final):
        def partial(group, n, sums):
            blank = lambda t: pa.nulls(len(group), t)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel(), pa.int64()))
            return [blank(pa.list_(pa.int32())), pa.array(group, pa.int32()), blank(pa.float64()), blank(pa.float64()), blank(pa.int64()), pa.array(n, pa.int64()), lists]

        def run(batches):
            counts, sums, ids = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), 1 if final else dims), np.int64), None
            for b in batches:
                ids = b.schema.field(0).type
                if not b.num_rows:
                    continue
                if before is None:
                    q = floors(b.column(1), scale, dims)
                    of, up, low = np.zeros(len(q), np.int64), np.full(len(q), np.inf), np.zeros(len(q))
                else:
                    q = np.asarray(b.column(1).flatten(), np.int64).reshape(-1, dims)
                    of = b.column(2).to_numpy().astype(np.int64)
                    up, low = moved_bounds(of, b.column(3).to_numpy(), b.column(4).to_numpy(), before, centroids)
                of, up, low = exponion(q, of, up, low, centroids)
                dist = ((q - centroids[of]) ** 2).sum(1)
                g, n, s = summed(of, dist[:, None] if final else q)
                counts[g] += n
                sums[g] += s
                vecs = pa.nulls(len(q), pa.list_(pa.int32())) if final else pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * dims, pa.int32()), pa.array(q.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), vecs, pa.array(of, pa.int32()), pa.array(up), pa.array(low), pa.array(dist), pa.nulls(len(q), pa.int64()), pa.nulls(len(q), pa.list_(pa.int64()))], names)
            if full := np.flatnonzero(counts).tolist():
                yield pa.RecordBatch.from_arrays([pa.nulls(len(full), ids), *partial(full, counts[full], sums[full])], names)

        return run

    names = ["vec_id", "q", "cluster", "upper", "lower", "distance", "n", "sums"]
    state = None
    before = None
    for step in range(rounds + 1):
        source = kept if state is None else state.where("n IS NULL").select(*names[:5])
        last, state = state, materialize(source.mapInArrow(assign(cents, before, step == rounds), shape), "kmeans")
        if last is not None:
            release(last)
        got = total_sums(state.where("n IS NOT NULL").select("cluster", "n", "sums"), "cluster", 1 if step == rounds else dims)
        if step < rounds:
            before, cents = cents, cents.copy()
            for j, (n, sums) in got.items():
                cents[j] = [s // n for s in sums]
    inertia = sum(s[0] for _, s in got.values())
    about = [(j, s[0], inertia, hashlib.sha256(",".join(map(str, cents[j].tolist())).encode()).hexdigest()) for j, (_, s) in got.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")  # a row for each cluster
    return state.where("n IS NULL").select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
