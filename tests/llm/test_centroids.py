import hashlib
import math

import numpy as np
import pytest

from spectraloom.llm.centroids import Bisectors, cluster, limbs

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, v string, distance int"


def brute(rows, k, rounds, dim, scale=256, seed=2):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x) for x in v]))
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in starts[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        mine = {}
        for _, v in kept:
            mine.setdefault(nearest(v)[1], []).append(v)
        for n, vs in mine.items():
            centroids[n] = [sum(c) // len(vs) for c in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept]
    top = 2**63 - 1
    inertia = {}
    for _, d, n in found:
        inertia[n] = inertia.get(n, 0) + min(d, top)
    total = min(sum(inertia.values()), top)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, min(d, top), min(inertia[n], top), total, sha[n]) for i, d, n in found), key=repr)


def vectors(seed=5, n=160, dim=4):
    rnd = np.random.default_rng(seed)
    rows = [(i, np.round(rnd.normal(size=dim), 1).tolist()) for i in range(n)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * dim), (903, [float("-inf")] * dim)]
    rows += [(904, [0.5] * (dim + 1)), (905, []), (None, [0.25] * dim), (None, [-3.0] * dim)]
    rows += [rows[0], rows[7], (7, [9.0] * dim)]
    return [(i, v, "x", "y", 3) for i, v in rows]


@pytest.mark.parametrize("k, rounds", [(1, 2), (7, 5), (40, 3)])
def test_equals_brute_force(spark, k, rounds):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in cluster(df, k, rounds, dim=4).collect()), key=repr)
    assert got == brute(rows, k, rounds, 4)


def test_values_beyond_doubles_and_longs_stay_exact(spark):
    rows = vectors(n=30) + [(1000 + i, [x, -x, 3.0 * i, 0.3], "x", "y", 3) for i, x in enumerate([1e6, 1e15, 2.0**53 + 2, 1e30, 3e38, 1e306])]
    got = sorted((tuple(r) for r in cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), 6, 4, dim=4).collect()), key=repr)
    assert got == brute(rows, 6, 4, 4)


def test_few_vectors_and_empty_tables(spark):
    rows = vectors()[:3]
    assert sorted((tuple(r) for r in cluster(spark.createDataFrame(rows, SCHEMA), 40, 5, dim=4).collect()), key=repr) == brute(rows, 40, 5, 4)
    nothing = cluster(spark.createDataFrame([], SCHEMA), dim=4)
    assert nothing.collect() == [] and nothing.columns[0] == "vec_id"
    assert cluster(spark.createDataFrame([(None, [1.0] * 4, "x", "y", 1)], SCHEMA), dim=4).collect() == []


def test_ties_go_to_the_smaller_number():
    b = Bisectors([[0, 0], [4, 0], [0, 4], [4, 4], [0, 0]])
    numbers, distances = b.winners(np.array([[2.0, 2.0], [2.0, 0.0], [4.0, 2.0], [3.0, 4.0], [0.0, 0.0]]))
    assert numbers.tolist() == [0, 0, 1, 3, 0] and distances == [8, 4, 4, 1, 0]


def test_limbs_add_up():
    for value in (0, 1, -1, 2**32 - 1, -(2**32), 2**70 + 5, -(2**90) - 7, 3 * 2**31):
        assert sum(v << (32 * p) for p, v in limbs(value)) == value
        assert all(abs(v) <= 2**32 for _, v in limbs(value))
