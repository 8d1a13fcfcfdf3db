"""Line dedup by alignment: blocks of lines that an earlier document has too are cut from later ones.

Finding partners. A line is known by the hash of its trimmed text; blank lines do not count. A document's
seeds are the shortest runs of its consecutive lines with `min_words` words: from each line on, up to each
line, and of two lines at least as well as of one. Every line of a shared block, and every two neighbours in
it, lie in a seed within the block. A later holder of a seed is linked with the seed's first holder: one link
per seed and document, however many hold it, and no shared block is lost. Seeds take the place of single
rare lines, as a block may consist of lines that are all frequent.

Aligning. What travels to a pair of documents are the places of the seeds that link them, so rows grow with
the seeds, not with pairs times lines. The two sequences of seeds are aligned by patience diff: equal seeds
at both ends of a range match; then the seeds that occur once on either side are matched along their longest
increasing run, and the ranges between them are aligned in turn; a range without such seeds is aligned by
an ordinary longest common subsequence. An alignment is in order and takes each place once, so what it leaves
of the later document (blocks that moved or are repeated) is aligned with the earlier one again, until
nothing matches. Lines under matched seeds, and blank lines inside them, are cut from the later document. The
cuts of a document are thus those that comparing it with all earlier ones would give.

A document's place in time is its id. Cases: rows without an id are never cut and cut nothing; rows that
repeat an id are versions of one document and are not compared with each other, but each is cut (rows
that repeat id and text too get the same cuts); NULL
texts stay NULL; a document cut in full becomes an empty text; an empty table gives an empty result.
Other columns are kept as they are, whatever their names.
"""

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectraloom.session import handed_over

from .names import free_name
from .words import mix

MIN_WORDS = 20


def longest_increasing(values):
    """Indexes of a longest increasing run of distinct numbers."""
    tails, tail_at, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            tail_at.append(i)
        else:
            tails[k], tail_at[k] = v, i
        before[i] = tail_at[k - 1] if k else -1
    out, i = [], tail_at[-1] if tail_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a, b):
    """Matched index pairs of two sequences, in order."""
    matches, ranges = [], [(0, len(a), 0, len(b))]
    while ranges:
        i, m, j, n = ranges.pop()
        while i < m and j < n and a[i] == b[j]:
            matches.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            matches.append((m, n))
        if i == m or j == n:
            continue
        once_a, once_b = _once(a, i, m), _once(b, j, n)
        anchors = sorted((at, once_b[x]) for x, at in once_a.items() if x in once_b)
        if not anchors:
            matches += [(i + p, j + q) for p, q in common_subsequence(a[i:m], b[j:n])]
            continue
        anchors = [anchors[k] for k in longest_increasing([q for _, q in anchors])]
        matches += anchors
        edges = [(i - 1, j - 1), *anchors, (m, n)]
        ranges += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:]) if p + 1 < r and q + 1 < s]
    return sorted(matches)


#: bits that the rows of one subsequence may take
MOST_BITS = 1 << 28


def common_subsequence(a, b):
    """Index pairs of a longest common subsequence, by bits of long integers.

    Rows are kept for the way back; beyond `MOST_BITS` of them `a` is taken in pieces, each against what of
    `b` follows the last match, which keeps the order and finds a match if there is one.
    """
    out, start, piece = [], 0, max(MOST_BITS // max(len(b), 1), 1)
    for begin in range(0, len(a), piece):
        found = _subsequence(a[begin : begin + piece], b[start:])
        out += [(begin + p, start + q) for p, q in found]
        start = out[-1][1] + 1 if out else 0
    return out


def _subsequence(a, b):
    places = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full, size = (1 << len(b)) - 1, len(b) // 8 + 1
    row, rows = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row.to_bytes(size, "little"))
    out, i, j = [], len(a), len(b)
    free = lambda i, j: rows[i][j >> 3] >> (j & 7) & 1
    while i and j:
        if free(i - 1, j - 1):
            j -= 1
        else:
            i -= 1
            if not i or free(i - 1, j - 1):
                j -= 1
                out.append((i, j))
    return out[::-1]


def repeated_alignment(a, b):
    """Indexes of `a` matched when what is left of it is aligned with `b` again and again; both are sequences."""
    found, left = [], list(range(len(a)))
    while left:
        matched = {i for i, _ in patience([a[k] for k in left], b)}
        if not matched:
            break
        found += [left[i] for i in matched]
        left = [k for i, k in enumerate(left) if i not in matched]
    return sorted(found)


def _once(seq, start, end):
    seen = {}
    for i in range(start, end):
        seen[seq[i]] = -1 if seq[i] in seen else i
    return {x: i for x, i in seen.items() if i >= 0}


def seeds(lines, min_words):
    """(start, end) indexes of the seeds of `lines`: sorted (ordinal, hash, words, ...), runs have successive ordinals."""
    found, start = set(), 0
    for stop in range(1, len(lines) + 1):
        if stop < len(lines) and lines[stop][0] == lines[stop - 1][0] + 1:
            continue
        upto = [0, *accumulate(x[2] for x in lines[start:stop])]
        n = len(upto) - 1
        for i in range(n):
            if lines[start + i][2] >= min_words:
                found.add((start + i, start + i))
            end = max(bisect_left(upto, upto[i] + min_words), i + 2)  # the run from i
            if end <= n:
                found.add((start + i, start + end - 1))
            begin = min(bisect_right(upto, upto[i + 1] - min_words) - 1, i - 1)  # the run up to i
            if begin >= 0:
                found.add((start + begin, start + i))
        start = stop
    return sorted(found)


def aligned_blocks(a, b):
    """Merged (first, last) places of the blocks of `a` that `b` has too.

    `a` holds (order, seed, first place, last place) of the later document's seeds, `b` (order, seed) of the
    earlier one's; orders tell overlapping seeds apart.
    """
    a, b = sorted(a), sorted(b)
    matched = repeated_alignment([x[1] for x in a], [x[1] for x in b])
    merged = []
    for first, last in sorted((a[k][2], a[k][3]) for k in matched):
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def _entries(docs, doc_id, text):
    """(id, version, entries): the non-blank lines of each document with id, as ordinal, place, hash, words."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("version"), F.col(text).alias("_t"))
    rows = rows.filter("id is not null and _t is not null").withColumn(
        "l", F.filter(F.transform(F.split("_t", "\n"), lambda x, i: F.struct(i.alias("place"), F.trim(x).alias("line"))), lambda x: x.line != "")
    )
    return rows.select(
        "id",
        "version",
        F.transform(
            "l",
            lambda x, i: F.struct(
                i.alias("ordinal"), x.place.alias("place"), F.xxhash64(x.line).alias("h"),
                (F.length(x.line) - F.length(F.replace(x.line, F.lit(" "), F.lit(""))) + 1).alias("words"),
            ),
        ).alias("entries"),
    )


def _lines_of(entries):
    """One row per non-blank line. A document's lines meet as a set, so rows that repeat id and text are one."""
    return entries.select("id", "version", F.inline("entries"))


SEEDS = "id bigint, version bigint, seed bigint, at array<struct<place: bigint, first: int, last: int>>"


def _seeds_of(kept, min_words):
    """(id, version, seed, at): the distinct seeds of every document and their places, in order."""
    place = pa.struct([("place", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # one document at a time as Python objects
                key, version, found = (batch.column(i)[k].as_py() for i in range(3))
                lines = sorted((x["ordinal"], x["h"], x["words"], x["place"]) for x in found)
                runs = seeds(lines, min_words)
                if not runs:
                    continue
                h = mix(np.array([x[1] for x in lines], np.int64).view(np.uint64))
                s, t = np.array(runs).T
                out = mix((t - s + 1).astype(np.uint64))
                for i in range(int((t - s).max()) + 1):  # a seed has `min_words` lines at most, or two
                    on = s + i <= t
                    out[on] = mix(out[on] * np.uint64(0x9E3779B97F4A7C15) + h[s[on] + i])
                where = np.array([x[3] for x in lines], np.int32)
                # runs come in order of start and end
                order = np.argsort(out, kind="stable")
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(out[order].view(np.int64)) != 0, [True]]))
                at = pa.StructArray.from_arrays([pa.array(order.astype(np.int64)), pa.array(where[s[order]]), pa.array(where[t[order]])], fields=list(place))
                n = len(cuts) - 1
                columns = [pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, version, np.int64))]
                columns += [pa.array(out[order][cuts[:-1]].view(np.int64)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), at)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "seed", "at"])

    return kept.mapInArrow(work, SEEDS)


def _links(found):
    """(id, version, e, e_version, at, e_at): every seed of a later document with its places in the first holder."""
    first = found.groupBy("seed").agg(F.min(F.struct("id", "version")).alias("f"), F.max("id").alias("last"))
    first = first.filter(F.col("f.id") < F.col("last")).select("seed", F.col("f.id").alias("e"), F.col("f.version").alias("e_version"))
    held = found.join(first, "seed")
    mine = (F.col("id") == F.col("e")) & (F.col("version") == F.col("e_version"))
    there = held.filter(mine).select(F.col("seed").alias("e_seed"), F.col("at").alias("e_at"))
    return held.filter(F.col("id") > F.col("e")).join(there, F.col("seed") == F.col("e_seed")).drop("e_seed")


def cut_ranges(docs, doc_id="doc_id", text="text", min_words=MIN_WORDS):
    """(id, version, cuts): places of the lines to cut, as array<struct<first, last>>, for documents with any."""
    entries = _entries(docs, doc_id, text)
    held = entries.select("id", F.explode(F.array_distinct(F.transform("entries", lambda x: x.h))).alias("h"))
    shared = held.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    shared = shared.filter("first < last").select("h")
    kept = _lines_of(entries).join(shared, "h").groupBy("id", "version").agg(F.collect_set(F.struct("ordinal", "h", "words", "place")).alias("lines"))
    links = _links(handed_over(_seeds_of(kept, min_words), "seeds"))
    pairs = links.groupBy("id", "version", "e", "e_version").agg(F.collect_list(F.struct("seed", "at", "e_at")).alias("seeds"))

    def work(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):  # one pair of documents at a time as Python objects
                key, version, found = (batch.column(i)[k].as_py() for i in range(3))
                a = [(x["place"], row["seed"], x["first"], x["last"]) for row in found for x in row["at"]]
                b = [(x["place"], row["seed"]) for row in found for x in row["e_at"]]
                out += [(key, version, first, last) for first, last in aligned_blocks(a, b)]
            if out:
                ids, versions, firsts, lasts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
                    names=["id", "version", "first", "last"],
                )

    cuts = pairs.select("id", "version", "seeds").mapInArrow(work, "id bigint, version bigint, first int, last int")
    return cuts.groupBy("id", "version").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))


def cut_shared_blocks(docs, doc_id="doc_id", text="text", min_words=MIN_WORDS, removed="n_removed"):
    """`docs` with the blocks cut from `text`, and the number of lines cut in a column named `removed`.

    If `docs` has a column of that name, underscores are appended to the new one.
    """
    removed = free_name(removed, docs.columns)
    cuts = cut_ranges(docs, doc_id, text, min_words).select(
        F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("cuts").alias("_cuts")
    )
    same = (docs[doc_id].cast("bigint") == cuts["_id"]) & (F.xxhash64(docs[text]) == cuts["_version"])
    joined = docs.select(*[docs[c] for c in docs.columns]).join(cuts, same, "left")
    lines = F.split(docs[text], "\n")
    left = F.filter(lines, lambda x, i: ~F.exists(cuts["_cuts"], lambda c: (c["first"] <= i) & (i <= c["last"])))
    new = F.when(cuts["_cuts"].isNull(), docs[text]).otherwise(F.array_join(left, "\n"))
    gone = F.when(
        cuts["_cuts"].isNull(), F.lit(0)
    ).otherwise(F.size(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.exists(cuts["_cuts"], lambda c: (c["first"] <= i) & (i <= c["last"])))))
    columns = [new.alias(c) if c == text else docs[c] for c in docs.columns]
    return joined.select(*columns, gone.cast("bigint").alias(removed))
