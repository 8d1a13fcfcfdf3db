import numpy as np

from spectraloom.llm.topk import TILES, grid, quantized, top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, dim string, score string"


def vectors():
    rnd = np.random.default_rng(5)
    rows = [(i, np.round(rnd.normal(size=6), 1).tolist()) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(250, [0.5] * 4), (251, [0.5] * 4), (252, []), (300, [])]
    rows += [rows[0], rows[7], (350, [3e38, -3e38, 1e30, 0.0, 0.0, 0.0]), (351, [3e38, 3e38, 1e30, 0.0, 0.0, 1.0])]
    return [(i, v, 0, "x", "y", "z") for i, v in rows]


def brute(rows, k):
    seen = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            f = [float(np.float32(x)) for x in v]
            seen[i] = [int(np.floor(x * 256)) if abs(x) < 2**40 else int(x * 256) for x in f]
    out, top = set(), 2**63 - 1
    for q, a in seen.items():
        if q % 50 == 0:
            scores = [
                (-max(-top - 1, min(top, sum(x * y for x, y in zip(a, b)))), c)
                for c, b in seen.items() if c != q and len(a) == len(b)
            ]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k])}
    return out


def test_equals_brute_force_with_small_tiles(spark):
    rows = vectors()
    v = quantized(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = top_k(v.filter("vec_id % 50 = 0"), v, 5, query_block=2, shard_rows=7).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows, 5)


def test_fewer_candidates_than_k_and_empty_table(spark):
    v = quantized(spark.createDataFrame(vectors()[:3], SCHEMA))
    assert {tuple(r) for r in top_k(v.filter("vec_id = 0"), v, 5).collect()} == brute(vectors()[:3], 5)
    empty = quantized(spark.createDataFrame([], SCHEMA))
    assert top_k(empty, empty, 5).collect() == []


def test_copies_of_blocks_grow_with_the_square_root():
    for q, c in ((1, 1), (1, 50), (20, 1000), (2000, 100_000), (7, 0), (0, 9)):
        rows, columns = grid(q, c, 200)
        tiles = q * c
        cells = min(max(tiles, 1), max(200, -(-tiles // TILES)))
        assert 1 <= rows <= max(q, 1) and 1 <= columns <= max(c, 1)
        if tiles:
            assert q * columns + c * rows <= 2.2 * (cells * tiles) ** 0.5 + q + c
            assert rows * columns >= min(cells, tiles) * 0.6
    # twice the rows on both sides: twice as many blocks, under four times the copies of a cell's cost
    small, large = (2000 * grid(2000, 10**5, 200)[1], 4000 * grid(4000, 2 * 10**5, 200)[1])
    assert large <= 4.1 * small
