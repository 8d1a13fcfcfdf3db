"""Packing of documents into training windows by the online sum-of-squares rule.

Each task packs the documents of its own partition, so nothing is shuffled. A document longer
than a window fills whole windows first; its rest (or a short document) is one item. For an item
of size s the rule looks at every fill level h of the open windows (0 is a new window) and takes
the one that makes the sum of squares of the level counts smallest after the move h -> h + s; full
windows do not count. The counts are one array over levels, so an item costs one vector operation.

When a partition ends, its open windows are merged by cutting the documents of the emptiest
windows into the gaps of the fullest: one window of a partition at most is left with padding.
Window ids are unique over the job: partition number times 2^32 plus a running number.

Cases: a NULL text is an empty one and still carries its end token; an empty table gives no rows;
rows that repeat are packed each; NULL ids pass through; other columns are ignored, whatever
their names. A very long text is cut into as many windows as it needs.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from .wordpieces import encoder

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, sequence_tokens bigint, ids binary"
)
FLUSH_ROWS = 2000


class SumOfSquares:
    """Open windows by fill level; `put` returns the windows it has filled.

    An item is a tuple whose last entry is its length; a window is a list of items.
    """

    def __init__(self, size):
        self.size = size
        self.counts = np.zeros(size, dtype=np.int64)
        self.open = [[] for _ in range(size)]

    def level_for(self, length):
        n = self.counts
        top = self.size - length
        # change of the sum of squares: one window fewer at h, one more at h + length
        change = np.where(n[: top + 1] > 0, 1 - 2 * n[: top + 1], np.iinfo(np.int64).max // 2)
        change[0] = 0
        change[:top] += 2 * n[length : length + top] + 1
        # of equal changes the fullest window
        return top - int(np.argmin(change[::-1]))

    def put(self, item):
        length = item[-1]
        level = self.level_for(length)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = []
        window.append(item)
        if level + length == self.size:
            return window
        self.open[level + length].append(window)
        self.counts[level + length] += 1
        return None

    def leftovers(self):
        """Open windows, fullest first."""
        return [w for level in range(self.size - 1, 0, -1) for w in self.open[level]]


def close(windows, size):
    """Fill the gaps of the fullest windows with cut items of the emptiest ones.

    Items are (document, start, length); the last window returned may be open.
    """
    done, first = [], 0
    windows = [list(w) for w in windows]
    last = len(windows) - 1
    while first < last:
        window = windows[first]
        gap = size - sum(i[-1] for i in window)
        while gap and first < last:
            doc, start, length = windows[last].pop()
            take = min(gap, length)
            window.append((doc, start, take))
            gap -= take
            if take < length:
                windows[last].append((doc, start + take, length - take))
            if not windows[last]:
                last -= 1
        if gap == 0:
            done.append(window)
            first += 1
    return done + [w for w in windows[first : last + 1] if w]


class Packer:
    """Cuts documents (id, token bytes) and yields windows as rows."""

    def __init__(self, size, base, with_ids):
        self.size, self.with_ids = size, with_ids
        self.next = base
        self.levels = SumOfSquares(size)
        self.rows = []

    def add(self, doc_id, raw):
        n = len(raw) // 4
        doc, start = (doc_id, raw, n), 0
        while n - start >= self.size:
            self._emit([(doc, start, self.size)])
            start += self.size
        if start < n:
            full = self.levels.put((doc, start, n - start))
            if full:
                self._emit(full)

    def finish(self):
        for window in close(self.levels.leftovers(), self.size):
            self._emit(window)

    def _emit(self, window):
        fill, offset = sum(i[-1] for i in window), 0
        for (doc_id, raw, n), start, length in window:
            ids = raw[4 * start : 4 * (start + length)]
            self.rows.append(
                (doc_id, start, length, zlib.crc32(ids), n, self.next, offset, fill, ids if self.with_ids else None)
            )
            offset += length
        self.next += 1

    def batch(self, schema):
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema
        )


ARROW = pa.schema(
    [
        pa.field(name, pa.binary() if kind == "binary" else pa.int64())
        for name, kind in (part.split() for part in PIECES.split(", "))
    ]
)


def pack_documents(docs, tokenizer_path, size=2048, end_id=1, doc_id="doc_id", text="text", with_ids=True):
    """Pieces of `docs` in windows of at most `size` tokens.

    One row per piece: `start` and `length` in its document, `sequence_id` and gapless `offset` in its
    window, the ids as bytes (little-endian unsigned 32-bit) unless `with_ids` is false.
    `sequence_tokens` is the window's fill; a window is padded to `size` unless its fill is a power of
    two, for which training has its own shapes.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batches):
        encode = encoder(tokenizer_path).encode
        packer = Packer(size, TaskContext.get().partitionId() << 32, with_ids)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                for key, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    packer.add(key, raw + end)
                if len(packer.rows) >= FLUSH_ROWS:
                    yield packer.batch(ARROW)
        packer.finish()
        if packer.rows:
            yield packer.batch(ARROW)

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text)).mapInArrow(work, PIECES)
