"""Exact top-k search by inner product, in tiles.

Queries and candidates are packed into blocks of rows (one binary matrix per row of the table).
Every block of candidates meets every block of queries, one matrix product per pair: the blocks are
counted, query blocks and candidate blocks are dealt to the rows and columns of a grid, and an equi-join
on its cells brings them together. The grid's sides are chosen so that the copies of blocks, one per cell
of a row or column, grow with the square root of the tiles. A tile keeps its k best per query; a task
merges its tiles' lists as it goes; the tasks' lists merge in a tree: first within groups of tasks, then
over all.
Vectors are integers floor(scale * x), products are exact: in doubles while they stay below 2^53,
in Python integers beyond.

Cases: vectors that are NULL or hold NULL or non-finite components take no part, neither do rows
without an id; vectors meet only vectors of their own length; a candidate with the query's id is the
query's own row; ties go to the smaller id; rows repeated in full count once; an empty table gives an
empty result. A product beyond the range of a long is reported as the nearest long. Other columns are
ignored, whatever their names.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from spectraloom.session import handed_over

#: tiles of a grid cell: enough to share a block's transport, few enough to recompute
TILES = 64
BLOCK = "dim int, block bigint, ids binary, vectors binary"
FAN_IN = 64
#: lists a task holds before it passes them on; more lists per query only mean more to merge
MOST_LISTS = 200_000
LONG = 2**63 - 1


def quantized(vectors, vec_id="vec_id", embedding="embedding", scale=256):
    """(vec_id, v): distinct rows with whole finite vectors, as doubles holding integers."""
    v = F.col(embedding).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v"))
    out = out.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False)))
    # floor of a double as a double: scaling by a power of two is exact
    floor = lambda x: F.when(F.abs(x) < 2**40, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return out.select("vec_id", F.transform("v", floor).alias("v"))


def _blocks(rows, size, first):
    """Blocks of at most `size` rows of one length; `first(partition)` numbers them."""
    from pyspark import TaskContext

    def work(batches):
        held, number = {}, first(TaskContext.get().partitionId())

        def emit(dim):
            nonlocal number
            ids, matrix = zip(*held.pop(dim))
            number += 1
            return pa.RecordBatch.from_pydict(
                {
                    "dim": pa.array([dim], pa.int32()), "block": pa.array([number], pa.int64()),
                    "ids": [np.array(ids, dtype="<i8").tobytes()], "vectors": [np.array(matrix, dtype="<f8").tobytes()],
                }
            )

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            stops = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))])
            for i, key in enumerate(batch.column(0).to_pylist()):
                v = flat[stops[i] : stops[i + 1]]
                held.setdefault(len(v), []).append((key, v))
                if len(held[len(v)]) == size:
                    yield emit(len(v))
        for dim in list(held):
            yield emit(dim)

    return rows.mapInArrow(work, BLOCK)


def _product(a, b):
    """Exact inner products of integer rows, as an integer matrix (object dtype only if needed)."""
    largest = max(np.abs(a).max(initial=0.0), 1.0) * max(np.abs(b).max(initial=0.0), 1.0) * max(a.shape[1], 1)
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).astype(object) @ whole(b).astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def tile_best(query_ids, queries, ids, vectors, k):
    """Per query the k best (score, id) of one tile, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    scores = _product(queries, vectors)
    out = []
    for q, row in zip(query_ids.tolist(), scores):
        if len(row) > k + 1:
            # everything that reaches the (k+1)-th score: the query itself may be among them
            limit = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
            at = np.flatnonzero(row >= limit)
        else:
            at = np.arange(len(row))
        at = at[ids[at] != q]
        best = at[np.lexsort((ids[at], -row[at].astype(object) if row.min(initial=0) == -LONG - 1 else -row[at]))][:k]
        out.append([(int(row[i]), int(ids[i])) for i in best])
    return out


def grid(n_queries, n_shards, tasks):
    """(rows, columns) of the grid: every query block is copied to all columns, every shard to all rows.

    There is a cell for each task, and more if one would have over `TILES` tiles. For c cells, copies
    are fewest, 2 * sqrt(c * n_queries * n_shards), where the sides are as the numbers of blocks.
    """
    tiles = max(n_queries * n_shards, 1)
    cells = min(tiles, max(tasks, -(-tiles // TILES)))
    rows = min(max(round(math.sqrt(cells * n_queries / max(n_shards, 1))), 1), max(n_queries, 1))
    return rows, min(-(-cells // rows), max(n_shards, 1))


def top_k(queries, candidates, k, query_block=1024, shard_rows=4096):
    """(query_id, rank, vec_id, score): `queries` and `candidates` come from `quantized`."""
    queries, candidates = queries.distinct(), candidates.distinct()
    packed = _blocks(queries, query_block, lambda p: p << 32).select(
        F.col("dim").alias("q_dim"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")
    )
    packed = handed_over(packed, "queries")
    shards = handed_over(_blocks(candidates, shard_rows, lambda p: p << 32), "shards")
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, columns = grid(packed.count(), shards.count(), tasks)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n)).cast("int")
    packed = packed.withColumn("q_row", dealt("q_block", rows)).withColumn("q_column", every(columns))
    shards = shards.withColumn("column", dealt("block", columns)).withColumn("row", every(rows))
    cell = (shards["row"] == packed["q_row"]) & (shards["column"] == packed["q_column"])
    tiles = shards.join(packed, (shards["dim"] == packed["q_dim"]) & cell)

    def work(batches):
        from pyspark import TaskContext

        task, best = TaskContext.get().partitionId(), {}

        def flush():
            rows = [(b, i, q, task, v, s) for (b, i, q), found in best.items() for s, v in found]
            best.clear()
            for at in range(0, len(rows), 20000):
                columns = list(zip(*rows[at : at + 20000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=LISTS)

        for batch in batches:
            if len(best) > MOST_LISTS:
                yield from flush()
            for dim, ids, vectors, q_block, q_ids, q_vectors in zip(*(batch.column(i).to_pylist() for i in range(6))):
                q, c = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                tile = tile_best(
                    q, np.frombuffer(q_vectors, "<f8").reshape(len(q), dim), c,
                    np.frombuffer(vectors, "<f8").reshape(len(c), dim), k,
                )
                for i, found in enumerate(tile):
                    key = (q_block, i, int(q[i]))
                    merged = best.get(key, []) + found
                    best[key] = sorted(merged, key=lambda x: (-x[0], x[1]))[:k]
        yield from flush()

    lists = tiles.select("dim", "ids", "vectors", "q_block", "q_ids", "q_vectors").mapInArrow(
        work, ", ".join(f"{c} bigint" for c in LISTS)
    )
    query = ["q_block", "q_row", "query_id"]
    for by in ([*query, F.floor(F.col("task") / FAN_IN)], query):
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return lists.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


LISTS = ["q_block", "q_row", "query_id", "task", "vec_id", "score"]
