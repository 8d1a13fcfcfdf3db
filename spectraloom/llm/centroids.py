"""Centroid clustering of integer vectors; the nearest centroid is found by a tournament of bisectors.

Every pair of centroids i < j has a bisecting hyperplane with an integer normal 2 (c_j - c_i) and an
integer threshold |c_j|^2 - |c_i|^2. A vector's product with the normal is above the threshold if, and
only if, j is strictly nearer; at equality i, the smaller number, wins. The champion of the centroids
seen so far meets the next one, so k - 1 sign tests eliminate all others; only the last one's distance
is computed. Normals and thresholds are built once per task and round.

A round is one scan: tasks assign their vectors and send sums and counts per cluster, which Spark adds
up; k x dim numbers reach the driver. Sums travel as 32-bit limbs, so they are exact whatever the
number and size of the vectors. Products are exact in doubles while they stay below 2^53, in Python
integers beyond. Nothing is shuffled by cluster, so a cluster with most rows is no hot spot.

Cases: vectors that are NULL, of another length, or with NULL or non-finite components take no part;
a row without an id is assigned and counted, but never a start; rows repeated in full count each, and
so may start several centroids (equal hashes are ordered by vector); with fewer than k vectors every
one with an id starts a centroid; an empty table, or one without any id, gives an empty result;
distances and inertias beyond a long are reported as the largest long. Other columns are ignored,
whatever their names.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from spectraloom.session import handed_over

LONG = 2**63 - 1
EXACT = 2**53
BLOCK = 2048
LIMB = 32


def integer_vectors(column, dim, scale):
    """Places of the vectors that take part, and their components floor(scale * x).

    The matrix holds doubles, or Python integers if some do not fit a double exactly.
    """
    lengths = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    rows = np.flatnonzero(lengths == dim)
    x = flat[starts[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    whole = np.isfinite(x).all(axis=1)
    rows, x = rows[whole], x[whole]
    if np.abs(x).max(initial=0.0) * scale < EXACT:
        return rows, np.floor(scale * x)
    exact = np.frompyfunc(lambda v: int(v) * scale if abs(v) >= EXACT else int(np.floor(scale * v)), 1, 1)
    return rows, exact(x)


class Bisectors:
    """Normals and thresholds of all pairs of `centroids`, rows of Python integers."""

    def __init__(self, centroids):
        self.centroids = np.array(centroids, dtype=object)
        squares = (self.centroids**2).sum(axis=1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]
        self.largest = max(int(np.abs(self.centroids).max()), 1)
        self.doubles = None

    def _tables(self, x):
        largest = max(int(np.abs(x).max(initial=0)), self.largest)
        if x.dtype != object and 8 * largest * largest * x.shape[1] < EXACT:
            if self.doubles is None:
                self.doubles = [t.astype(np.float64) for t in (self.centroids, self.normals, self.thresholds)]
            return x, *self.doubles
        exact = x if x.dtype == object else np.frompyfunc(int, 1, 1)(x)
        return exact, self.centroids, self.normals, self.thresholds

    def winners(self, x):
        """(number of the nearest centroid, squared distance) per row of `x`; exact."""
        numbers, distances = [], []
        for at in range(0, len(x), BLOCK):
            part, centroids, normals, thresholds = self._tables(x[at : at + BLOCK])
            champion = np.zeros(len(part), np.int64)
            for other in range(1, len(centroids)):
                side = (part * normals[champion, other]).sum(axis=1) - thresholds[champion, other]
                champion[(side > 0).astype(bool)] = other
            numbers.append(champion)
            distances += [int(d) for d in ((part - centroids[champion]) ** 2).sum(axis=1)]
        return np.concatenate(numbers) if numbers else np.zeros(0, np.int64), distances


def limbs(value):
    """Summands value = sum(limb << 32 place): each limb fits a long, and so do sums of billions."""
    place = 0
    while abs(value) >> LIMB:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    yield place, value


SUMS = "cluster int, component int, place int, value bigint"


def _cluster_sums(vectors, centroids, dim, scale):
    """{cluster: (count, sums)} of one assignment of `vectors`."""

    def work(batches):
        bisectors = Bisectors(centroids)
        # the last column counts
        sums = np.zeros((len(centroids), dim + 1), dtype=object)
        for batch in batches:
            _, x = integer_vectors(batch.column(1), dim, scale)
            numbers, _ = bisectors.winners(x)
            for c in np.unique(numbers):
                mine = x[numbers == c]
                if mine.dtype == object:
                    total = mine.sum(axis=0)
                else:
                    # doubles below 2^53, taken apart so that no sum of a batch is rounded
                    high = np.floor(mine / 2**26)
                    low = (mine - high * 2**26).sum(axis=0)
                    total = [int(h) * 2**26 + int(v) for h, v in zip(high.sum(axis=0), low)]
                sums[c, :dim] += np.array(total, dtype=object)
                sums[c, dim] += len(mine)
        rows = [
            (c, d, place, value)
            for c in range(len(centroids)) if sums[c, dim]
            for d in range(dim + 1) for place, value in limbs(int(sums[c, d]))
        ]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "component", "place", "value"])

    added = vectors.mapInArrow(work, SUMS).groupBy("cluster", "component", "place").agg(F.sum("value").alias("value"))
    out = {}
    for r in added.collect():
        out.setdefault(r.cluster, [0] * (dim + 1))[r.component] += r.value << (LIMB * r.place)
    return {c: (s[dim], s[:dim]) for c, s in out.items()}


def _starts(vectors, k, dim, scale, seed):
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.filter(F.col("vec_id").isNotNull() & (F.size("v") == dim)).filter(ok)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    column = pa.array([r.v for r in first], pa.list_(pa.float64()))
    return [[int(x) for x in row] for row in integer_vectors(column, dim, scale)[1]]


def cluster(vectors, k=40, rounds=5, dim=64, scale=256, seed=2, vec_id="vec_id", embedding="embedding"):
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The start centroids are the k vectors with the smallest sha256 of `<seed>:<vec_id>`, in that order. Every
    round assigns all vectors and moves each centroid with vectors to the floor of their mean. The
    assignment returned is a last one, written to the shared folder once.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    centroids = _starts(vectors, k, dim, scale, seed)
    columns = "vec_id bigint, cluster int, distance bigint"
    result = columns + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], result)
    for _ in range(rounds):
        for c, (count, sums) in _cluster_sums(vectors, centroids, dim, scale).items():
            centroids[c] = [s // count for s in sums]

    def work(batches):
        bisectors = Bisectors(centroids)
        for batch in batches:
            rows, x = integer_vectors(batch.column(1), dim, scale)
            numbers, distances = bisectors.winners(x)
            arrays = [
                batch.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()),
                pa.array([min(d, LONG) for d in distances], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])

    assigned = handed_over(vectors.mapInArrow(work, columns), "clusters")
    # one row per cluster
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = min(sum(int(r.s) for r in inertia), LONG)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(r.cluster, min(int(r.s), LONG), total, sha[r.cluster]) for r in inertia]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
