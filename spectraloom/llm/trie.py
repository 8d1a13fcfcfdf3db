"""Conversation prefix trie: shared beginnings of conversations, counted in node tables addressed by a
minimal perfect hash.

A conversation is rebuilt first: `h` turns of its base conversation, then its own turns after its first
`h` (see `turns_of`). Its prefixes are enumerated by a chain of 128-bit digests, one row each, from rows
that hold digests instead of texts; equal prefixes meet in an aggregate that is combined before its
shuffle, so a prefix that most conversations share is no hot spot. What is left is one row per node.

Nodes are dealt to shards by their ancestor at a cut depth, so that every parent below the cut is in its
child's shard. A shard enumerates its digests, assigns each a slot of its own by a minimal perfect hash,
verifies the slots against the digests, scatters the counts into flat arrays and adds them up through
the array of parent slots, deepest nodes first. The levels above the cut follow by one aggregate each;
the usual cut is 1, which leaves only the root. If a subtree below the cut has more than `MAX_SHARD`
nodes (one opening that a third of all conversations share), the cut is doubled, so no shard is larger;
beyond the deepest node all levels are aggregates.

The ids of the conversations that end at a node are hashed in order: sorted chunks of neighbouring ids
are built in parallel, one task per node streams them through SHA-256, which is sequential by nature.

Cases: NULL turns come first; equal turns are ordered by the digest of role and text; repeated rows are
repeated turns; NULL roles and texts are empty; rows without a conversation id belong to none; a
conversation whose rebuilt form has no turn is a member of the root alone; a very long conversation is
streamed by one task in bounded memory; an empty table has no node at all. Other columns are ignored,
whatever their names.
"""

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectraloom.session import handed_over

from .words import mix

BLOCK = 100
MOST_SHARED = 5
ROOT = bytes(16)
#: nodes a shard holds at most, and nodes of small shards that are handled together
MAX_SHARD = 1_000_000
TOGETHER = 100_000
#: neighbouring ids per chunk: 2 ** CHUNK_BITS
CHUNK_BITS = 10
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def turns_of(rows, conv="conv_id", turn="turn", role="role", text="text"):
    """(base, conv, shared, turn, digest, chars): the turns of a table without their texts.

    The base of conversation c is c - c % 100; c takes crc32(decimal c) % 6 turns from it.
    """
    c = F.col(conv).cast("bigint")
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    marked = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return rows.filter(c.isNotNull()).select(
        (c - c % BLOCK).alias("base"), c.alias("conv"), (F.crc32(c.cast("string")) % (MOST_SHARED + 1)).cast("int").alias("shared"),
        F.col(turn).cast("bigint").alias("turn"), F.unhex(F.substring(F.sha2(marked, 256), 1, 32)).alias("digest"),
        F.length(text).cast("bigint").alias("chars"),
    )


PREFIXES = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, c1 bigint, c2 bigint, depth bigint, chars bigint, conv bigint, ends boolean"
PREFIX_TYPES = [pa.int64()] * 9 + [pa.bool_()]
PREFIX_NAMES = [c.split()[0] for c in PREFIXES.split(", ")]


class Prefixes:
    """Rows of the prefixes of one conversation after the other."""

    def __init__(self, cut):
        self.cut, self.rows, self.conv, self.last = cut, [], None, None

    def begin(self, conv):
        self.close()
        self.conv, self.key, self.depth, self.cut_key = conv, ROOT, 0, None
        self._add(ROOT, None, 0)

    def _add(self, key, parent, chars):
        if self.last:
            self.rows.append((*self.last, False))
        if self.depth == self.cut:
            self.cut_key = key
        two = struct.Struct("<qq").unpack
        none = (None, None)
        self.last = (*two(key), *(two(parent) if parent else none), *(two(self.cut_key) if self.cut_key else none), self.depth, chars, self.conv)

    def turn(self, digest, chars):
        parent, self.key = self.key, hashlib.blake2b(self.key + digest, digest_size=16).digest()
        self.depth += 1
        self._add(self.key, parent, chars)

    def close(self):
        if self.last:
            self.rows.append((*self.last, True))
        self.last = None

    def batch(self):
        columns = zip(*self.rows)
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PREFIX_TYPES)], names=PREFIX_NAMES)
        self.rows = []
        return out


def prefixes(turns, cut):
    """One row per rebuilt conversation and depth, 0 included: digests of node, parent and ancestor at `cut`."""
    # the base of a block comes first, then its other conversations one by one
    first = (F.col("conv") != F.col("base")).alias("after")
    order = [F.col("base"), first, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    sorted_turns = turns.repartition("base").sortWithinPartitions(*order).select("base", "conv", "shared", "digest", "chars")

    def work(batches):
        out, base, opening, own = Prefixes(cut), None, [], 0
        for batch in batches:
            for b, c, shared, digest, chars in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if b != base:
                    base, opening = b, []
                if c != out.conv:
                    out.begin(c)
                    own = 0
                    for turn in opening[:shared] if c != b else ():
                        out.turn(*turn)
                if c == b or own >= shared:
                    out.turn(digest, chars)
                own += 1
                if c == b and own <= MOST_SHARED:
                    opening.append((digest, chars))
                if len(out.rows) >= 10_000:
                    yield out.batch()
        out.close()
        if out.rows:
            yield out.batch()

    return sorted_turns.mapInArrow(work, PREFIXES)


def _end_hashes(rows):
    """(k1, k2, ends): SHA-256 over the ids of the conversations that end at a node, ascending, comma-joined."""
    chunk = F.shiftright("conv", CHUNK_BITS).alias("chunk")
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    chunks = rows.filter("ends").groupBy("k1", "k2", chunk).agg(F.array_join(ids, ",").alias("ids"))
    ordered = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").drop("chunk")

    def work(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key == (k1, k2):
                    digest.update(b",")
                else:
                    if key:
                        done.append((*key, digest.digest()))
                    key, digest = (k1, k2), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield _ends(done)
        if key:
            yield _ends([(*key, digest.digest())])

    return ordered.mapInArrow(work, "e1 bigint, e2 bigint, ends binary")


def _ends(rows):
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["e1", "e2", "ends"])


def _nodes(rows):
    """One row per distinct prefix. Two prefixes with one digest would differ in parent, depth or length: an error."""
    same = ("p1", "p2", "c1", "c2", "depth", "chars")
    out = rows.groupBy("k1", "k2").agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in same],
        *[F.min(c).alias(f"{c}_") for c in same],
    )
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return out.filter(F.when(equal, True).otherwise(F.raise_error(F.lit("two prefixes share a digest")))).drop(*[f"{c}_" for c in same])


# ---------------------------------------------------------------- shards


class PerfectHash:
    """Slots 0 .. n - 1 for n distinct pairs of 64-bit numbers, no two alike.

    Keys alone in a cell of a bit table get the cell's rank; the others go on to the next, smaller table.
    """

    def __init__(self, a, b):
        self.levels, left, used = [], np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("equal digests in one shard")
            cells = self._cells(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(cells, minlength=2 * len(left)) == 1
            self.levels.append((alone, used + np.cumsum(alone) - 1))
            used += int(alone.sum())
            left = left[~alone[cells]]

    @staticmethod
    def _cells(a, b, level, size):
        h = mix(mix(a + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) ^ b)
        return (h % np.uint64(size)).astype(np.int64)

    def slots(self, a, b):
        """Slot per key; for a key that was not built in, some slot or -1, so results are to be verified."""
        out, todo = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            cells = self._cells(a[todo], b[todo], level, len(alone))
            hit = alone[cells]
            out[todo[hit]] = rank[cells[hit]]
            todo = todo[~hit]
        return out


class NodeTable:
    """Flat arrays over the slots of a set of nodes."""

    def __init__(self, k1, k2):
        self.hash, self.n = PerfectHash(k1, k2), len(k1)
        self.slot = self.hash.slots(k1, k2)
        self.k1, self.k2 = self.scatter(k1), self.scatter(k2)
        if not (np.array_equal(self.k1[self.slot], k1) and np.array_equal(self.k2[self.slot], k2)):
            raise ValueError("two digests share a slot")

    def scatter(self, values):
        out = np.zeros(self.n, values.dtype)
        out[self.slot] = values
        return out

    def find(self, k1, k2):
        """Slots of keys, -1 for keys that are not in the table."""
        at = self.hash.slots(k1, k2)
        known = at >= 0
        known[known] = (self.k1[at[known]] == k1[known]) & (self.k2[at[known]] == k2[known])
        return np.where(known, at, -1)


def accumulate(k1, k2, p1, p2, depth, n_convs, chars):
    """Per node, in the order given: place of its parent or -1, n_children, n_leaves, saved_tokens."""
    table = NodeTable(k1, k2)
    parent = table.scatter(table.find(p1, p2))
    depth_at, inside = table.scatter(depth), parent >= 0
    children = np.bincount(parent[inside], minlength=table.n).astype(np.int64)
    leaves = (children == 0).astype(np.int64)
    saved = table.scatter((n_convs - 1) * chars)
    order = np.argsort(-depth_at, kind="stable")
    levels = np.flatnonzero(np.diff(depth_at[order])) + 1
    for nodes in np.split(order, levels):
        nodes = nodes[inside[nodes]]
        np.add.at(leaves, parent[nodes], leaves[nodes])
        np.add.at(saved, parent[nodes], saved[nodes])
    place = np.empty(table.n, np.int64)
    place[table.slot] = np.arange(table.n)
    up = parent[table.slot]
    return np.where(up >= 0, place[up], -1), children[table.slot], leaves[table.slot], saved[table.slot]


NODES = ["k1", "k2", "p1", "p2", "c1", "c2", "depth", "conv_id", "n_convs", "chars", "ends"]
COUNTED = "p1 bigint, p2 bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends binary"
COUNTED_NAMES = [c.split()[0] for c in COUNTED.split(", ")]


def _counted(table):
    """The rows of whole shards with their sums."""
    numbers = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in NODES[:4] + NODES[6:10]}
    keys = [numbers[c].view(np.uint64) for c in NODES[:4]]
    parent, children, leaves, saved = accumulate(*keys, numbers["depth"], numbers["n_convs"], numbers["chars"])
    above = pa.array(numbers["conv_id"][parent], mask=parent < 0)
    arrays = [table.column("p1"), table.column("p2"), table.column("depth"), table.column("conv_id"), above, table.column("n_convs")]
    arrays += [pa.array(children), pa.array(leaves), pa.array(saved), table.column("ends")]
    return pa.table(arrays, names=COUNTED_NAMES).to_batches(max_chunksize=10_000)


def count_shards(nodes, together=TOGETHER):
    """`nodes` below the cut, summed shard by shard; a task holds one shard, or small ones up to `together` nodes."""
    dealt = nodes.select(*NODES).repartition("c1", "c2").sortWithinPartitions("c1", "c2")

    def work(batches):
        held, n, last = [], 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            c1, c2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
            # places where a new shard starts
            starts = np.flatnonzero((np.diff(c1) != 0) | (np.diff(c2) != 0)) + 1
            if last is not None and len(c1) and last != (c1[0], c2[0]):
                starts = np.concatenate([[0], starts])
            begin = 0
            for at in starts.tolist():
                if n + at - begin >= together:
                    yield from _counted(pa.concat_tables([*held, table.slice(begin, at - begin)]))
                    held, n, begin = [], 0, at
            if len(c1):
                held.append(table.slice(begin))
                n += len(c1) - begin
                last = (c1[-1], c2[-1])
        if held:
            yield from _counted(pa.concat_tables(held))

    return dealt.mapInArrow(work, COUNTED)


def prefix_trie(rows, max_shard=None, together=None, **columns):
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. `columns` names the columns of `rows` (see `turns_of`).
    """
    max_shard, together = max_shard or MAX_SHARD, together or TOGETHER
    turns, cut = turns_of(rows, **columns), 1
    while True:
        chains = handed_over(prefixes(turns, cut), "prefixes")
        ends = _end_hashes(chains)
        nodes = _nodes(chains).join(ends, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left").drop("e1", "e2")
        nodes = handed_over(nodes, "nodes")
        below = nodes.filter(F.col("depth") >= cut)
        largest = below.groupBy("c1", "c2").count().agg(F.max("count")).first()[0] or 0
        if largest <= max_shard:
            break
        cut *= 2
    counted = handed_over(count_shards(below, together), "counted")

    # above the cut: a level from the sums of the level below
    above = nodes.filter(F.col("depth") < cut)
    roof = above.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("above"))
    up = (F.col("p1") == F.col("u1")) & (F.col("p2") == F.col("u2"))
    top = counted.filter(F.col("depth") == cut)
    finished = [counted.filter(F.col("depth") > cut).drop("p1", "p2")]
    # with the usual cut there is one row above; else adaptive execution splits a parent with very many children
    met = lambda level: level.drop("parent_conv_id").join(F.broadcast(roof) if cut == 1 else roof, up, "left").withColumnRenamed("above", "parent_conv_id")
    for depth in range(cut - 1, -1, -1):
        sums = top.groupBy(F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(
            F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved")
        )
        finished.append(met(top).drop("p1", "p2", "u1", "u2"))
        level = above.filter(F.col("depth") == depth).join(sums, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
        top = level.select(
            "p1", "p2", "depth", "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            F.coalesce("n_leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).cast("bigint").alias("saved_tokens"), "ends",
        )
    finished.append(top.drop("p1", "p2"))
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out.withColumn("ends_sha256", F.coalesce(F.lower(F.hex("ends")), F.lit(EMPTY_HASH))).drop("ends")
