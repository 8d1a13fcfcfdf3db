"""Near-duplicates by circulant MinHash, confirmed by exact Jaccard similarity.

Two permutations of 2^20 places give all coordinates of a signature: the first scatters a document's
shingles, the second, shifted circularly by k, ranks them for coordinate k. The smallest ranks over a
set are one running minimum over rows of a table of shifts. 240 coordinates make 40 bands of 6; at
similarity 0.8 a pair shares no band with probability 5e-6.

Documents with equal shingle sets form one class from the start and are never paired. In each bucket
of a band every class is compared with the bucket's smallest class only (one link per member, no pairs
within the group). What these stars leave open is settled from differences to the centre: members that
missed it are held against their star's members in blocks, and only links come out (`_late_links`).
Every pair of a bucket is thus compared or already connected. Links are confirmed on
the full sets of 64-bit shingle hashes.

Cases: NULL and wordless texts have empty sets and link with nothing; rows without an id are returned
with a NULL component and kept; rows that repeat an id are one document whose texts are linked; an
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from spectraloom.session import freeze, scratch_path

from .graph import components
from .words import hash_words, mix, row_slices, shingle_sets, text_bytes

PLACES_BITS = 20
BANDS, ROWS = 40, 6
MEMBERS_PER_TASK = 500
BROADCAST_IDS = 100_000
BLOCK_DIFFERENCES = 200_000
SIGNED = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>"


class Circulant:
    """Signatures from two permutations, the second one shifted."""

    def __init__(self, coordinates, bits=PLACES_BITS, seed=7):
        rnd = np.random.default_rng(seed)
        self.shift = np.uint64(64 - bits)
        self.first = rnd.permutation(1 << bits).astype(np.int64)
        second = rnd.permutation(1 << bits).astype(np.uint32)
        around = np.concatenate([second, second[:coordinates]])
        # row i holds the ranks of place i under every shift; a view, not a copy
        self.ranks = np.lib.stride_tricks.sliding_window_view(around, coordinates)

    def signature(self, shingles):
        places = self.first[mix(shingles) >> self.shift]
        least = None
        for at in range(0, len(places), 2048):
            part = self.ranks[places[at : at + 2048]].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least


_CIRCULANT = {}


def circulant(coordinates):
    if coordinates not in _CIRCULANT:
        _CIRCULANT[coordinates] = Circulant(coordinates)
    return _CIRCULANT[coordinates]


def band_keys(signature, bands, rows):
    values = signature.reshape(bands, rows).astype(np.uint64)
    key = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r])
    return key


def signatures(docs, doc_id, text, width, bands, rows, percent):
    """One row per document of `docs`: size and 128-bit digest of its set, band keys (none for small sets)."""

    def work(batches):
        make = circulant(bands * rows)
        for whole in batches:
            for batch in row_slices(whole, 1):
                n, h1, h2, keys = [], [], [], []
                for s in shingle_sets(*hash_words(*text_bytes(batch.column(1))), width):
                    n.append(len(s))
                    h1.append(int(np.bitwise_xor.reduce(s)) if len(s) else 0)
                    h2.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64)) if len(s) else 0)
                    # a set of n is at most n / (n + 1) similar to a larger one: at 80 percent 4 within 5 link, 3 within 4 do not
                    keys.append(band_keys(make.signature(s), bands, rows).view(np.int64) if len(s) * (100 - percent) >= percent else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)),
                        pa.array(np.array(h2, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SIGNED)


def _beside_centres(docs, pairs, width, doc_id, text, emit, schema):
    """`emit(c, x, centre set, member set)` rows for pairs (c, x), wherever a text of each meets.

    Rows are grouped by c in parts of about `MEMBERS_PER_TASK` members; a part starts with the centre's
    text, so a task holds one centre's set at a time.
    """
    parts = pairs.groupBy("c").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("parts"))
    members = pairs.join(parts, "c").select(
        "c", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("x").alias("node")
    )
    centres = parts.select("c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("c").alias("node"))
    wanted = members.unionByName(centres)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("text"))
    rows = wanted.join(texts, wanted["node"] == texts["_id"]).select("c", "part", "role", "node", "text")
    rows = rows.repartition("c", "part").sortWithinPartitions("c", "part", "role")

    def work(batches):
        key, own = None, []
        for whole in batches:
            for batch in row_slices(whole.select(["c", "part", "role", "node", "text"]), 4):
                c, part, role, node = (batch.column(i).to_pylist() for i in range(4))
                out = []
                for i, s in enumerate(shingle_sets(*hash_words(*text_bytes(batch.column(4))), width)):
                    if key != (c[i], part[i]):
                        key, own = (c[i], part[i]), []
                    if role[i] == 0:
                        own.append(s)
                    else:
                        out += [emit(c[i], node[i], o, s) for o in own]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema
                    )

    return rows.mapInArrow(work, from_arrow_schema(schema))


def _found(large, small):
    """Which entries of sorted `small` are in sorted `large`."""
    if not len(large):
        return np.zeros(len(small), bool)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return large[at] == small


def _sizes(c, x, o, s):
    shared = int(_found(o, s).sum())
    return c, x, shared, len(s) + len(o) - shared


def _differences(c, x, o, s):
    """Also the versions met (an id may have several texts) and what the member lacks and adds."""
    version = lambda v: int(np.bitwise_xor.reduce(v).view(np.int64)) if len(v) else 0
    gone, new = o[~_found(s, o)], s[~_found(o, s)]
    return c, version(o), x, version(s), len(o), gone.view(np.int64), new.view(np.int64)


def _arrow(names, lists=()):
    return pa.schema([(n, pa.int64()) for n in names] + [(n, pa.list_(pa.int64())) for n in lists])


def compare(docs, pairs, width, doc_id="doc_id", text="text"):
    """(c, x, shared, either): sizes of intersection and union of the shingle sets of pairs (c, x)."""
    found = _beside_centres(docs, pairs, width, doc_id, text, _sizes, _arrow(["c", "x", "shared", "either"]))
    # an id with several texts: its nearest one decides
    best = F.max(F.struct((F.col("shared") / F.col("either")).alias("s"), "shared", "either")).alias("b")
    return found.groupBy("c", "x").agg(best).select("c", "x", "b.shared", "b.either")


def near_duplicates(docs, doc_id="doc_id", text="text", width=5, percent=80, bands=BANDS, rows=ROWS):
    """(doc_id, n_shingles, component_id, kept): one row per row of `docs`.

    Documents are linked where 100 * intersection >= percent * union of their sets of `width`-word
    shingles; `component_id` is the smallest id reachable and `kept` marks that document.
    """
    signed = _stored(signatures(docs, doc_id, text, width, bands, rows, percent), "signatures")
    with_id = signed.filter("doc_id is not null and n_shingles > 0")
    digest = ["n_shingles", "h1", "h2"]
    classes = with_id.groupBy(*digest).agg(F.min("doc_id").alias("rep"))

    # one row of band keys per class: the rows of its representative
    reps = with_id.filter(F.col("n_shingles") * (100 - percent) >= percent).join(classes, digest).filter("doc_id = rep")
    keys = reps.select("rep", "n_shingles", F.explode("bands").alias("key"))
    centre = keys.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("last")).filter("c < last").drop("last")
    buckets = _stored(keys.join(centre, "key").filter("rep <> c").distinct(), "buckets")
    pairs = freeze(buckets.select("c", F.col("rep").alias("x")).distinct())
    linked = F.col("shared") * 100 >= F.col("either") * percent
    compared = freeze(compare(docs, pairs, width, doc_id, text))
    # rows that repeat an id with other texts join their classes
    again = with_id.join(classes, digest).filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    several = with_id.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b")
    again = again.join(several, again["u"] == several["doc_id"], "left_semi")
    links = compared.filter(linked).select(F.col("c").alias("u"), F.col("x").alias("v")).unionByName(again)
    labels = components(links)

    late = freeze(_late_links(docs, compared, labels, percent, width, doc_id, text))
    if late.limit(1).count():
        labels = components(links.unionByName(late))

    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        *[F.col(c).alias(f"_{c}") for c in digest], F.coalesce("component", "rep").alias("component_id")
    )
    same = [signed[c] == of_class[f"_{c}"] for c in digest]
    out = signed.drop("bands").join(of_class, same, "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _stored(df, name):
    """`df` written once to the shared folder as Parquet, which is smaller there than a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _few(docs, pairs, doc_id):
    """Only the documents in `pairs`, found without a shuffle if their counted number is small."""
    ids = freeze(pairs.select(F.explode(F.array("c", "x")).alias("_id")).distinct())
    if ids.count() > BROADCAST_IDS:
        return docs
    return docs.join(F.broadcast(ids), docs[doc_id].cast("bigint") == ids["_id"], "left_semi")


def _late_links(docs, compared, labels, percent, width, doc_id, text):
    """(u, v): links between members of one star in different components. One of them, y, missed the centre c.

    Members of a bucket are in its centre's star, and two that reached c share its component. So each y is
    held against all members of its star by what they lack and add relative to c: with n shingles in c, r of
    them lacking, a added, and o differences in common, |x & y| = n - r_x - r_y + o. The members of a star are
    packed into blocks of bounded size; blocks of members that missed meet all blocks of their star, and the
    counting is done on arrays within a pair of blocks. Per y one link to each other component is returned.
    """
    labels = labels.select(F.col("node").alias("x"), "component")
    members = compared.select("c", "x").join(labels, "x", "left").withColumn("component", F.coalesce("component", "x"))
    mixed = members.groupBy("c").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b")
    members = freeze(members.join(mixed.select("c"), "c", "left_semi"))
    pairs = members.select("c", "x")
    schema = _arrow(["c", "cv", "x", "xv", "n"], ["gone", "new"])
    apart = _beside_centres(_few(docs, pairs, doc_id), pairs, width, doc_id, text, _differences, schema)
    apart = apart.select("c", "cv", "x", "xv", "n", F.size("gone").alias("r"), F.size("new").alias("a"), F.concat("gone", "new").alias("d"))
    apart = _stored(apart.distinct().join(members, ["c", "x"]), "differences")

    def blocks(rows, name):
        star = ["c", "cv", "n"]
        parts = rows.groupBy(*star).agg(F.ceil(F.sum(F.size("d") + 1) / BLOCK_DIFFERENCES).cast("int").alias("parts"))
        spread = rows.join(parts, star).withColumn("part", F.pmod(F.xxhash64("x", "xv"), F.col("parts")))
        return spread.groupBy(*star, "part").agg(F.collect_list(F.struct("x", "component", "r", "a", "d")).alias(name)).drop("part")

    missed = (F.col("n") - F.col("r")) * 100 < (F.col("n") + F.col("a")) * percent
    met = blocks(apart.filter(missed), "ys").join(blocks(apart, "xs"), ["c", "cv", "n"]).select("n", "ys", "xs")

    def work(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):  # one pair of blocks at a time as Python objects
                n, ys, xs = (batch.column(i)[k].as_py() for i in range(3))
                out += _links_of_blocks(n, ys, xs, percent)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out)], names=["u", "v"])

    return met.mapInArrow(work, "u bigint, v bigint").distinct()


def _links_of_blocks(n, ys, xs, percent):
    """Links (x, y) across components between two blocks of a star's members."""
    each = np.concatenate([np.array(x["d"], np.int64) for x in xs])
    owner = np.repeat(np.arange(len(xs)), [len(x["d"]) for x in xs])
    order = np.argsort(each, kind="stable")
    each, owner = each[order], owner[order]
    r, a, component = (np.array([x[k] for x in xs]) for k in ("r", "a", "component"))
    out = []
    for y in ys:
        d = np.array(y["d"], np.int64)
        low, high = np.searchsorted(each, d), np.searchsorted(each, d, side="right")
        size = high - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        common = np.bincount(owner[at], minlength=len(xs))
        shared = n - r - y["r"] + common
        either = 2 * n - r + a - y["r"] + y["a"] - shared
        linked = np.flatnonzero((shared * 100 >= either * percent) & (component != y["component"]))
        for i in np.unique(component[linked], return_index=True)[1]:
            out.append((xs[linked[i]]["x"], y["x"]))
    return out
