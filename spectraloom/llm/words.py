"""Words of many texts at once: numpy over the bytes of an Arrow batch.

A word is a maximal run of characters other than space and tab to carriage return; A-Z count as
a-z. Each word becomes a 64-bit hash (a random value per byte, weighted by position, then mixed), so
nothing is done per word in Python. Texts are taken in chunks cut at white space, which bounds memory.
"""

import numpy as np

CHUNK = 1 << 20
U64 = np.uint64
_RANDOM = np.random.default_rng(20240229)
_BYTES = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64) | U64(1)
_BYTES[65:91] = _BYTES[97:123]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U64(0x9E3779B97F4A7C15)
#: powers of the base and of its inverse modulo 2 ** 64
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x):
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n, inverse):
    if len(_POWERS[inverse]) < n:
        grown = np.full(max(n, min(2 * n, CHUNK)), U64(pow(int(_BASE), -1, 1 << 64)) if inverse else _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS[inverse] = np.multiply.accumulate(grown)
    return _POWERS[inverse][:n]


def text_bytes(column):
    """(bytes, offsets) of a string column; NULL is empty."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type):
        kind = np.dtype("<i8")
    else:
        kind = np.dtype("<i4")
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, count=at[-1] - at[0], offset=at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _chunks(raw):
    start = 0
    while start < len(raw):
        end = min(start + CHUNK, len(raw))
        if end < len(raw):
            # the last white space, most likely among the last bytes
            low = max(start, end - 4096)
            blank = np.flatnonzero(_SPACE[raw[low:end]])
            if not len(blank):
                low, blank = start, np.flatnonzero(_SPACE[raw[start:end]])
            if len(blank):
                end = low + int(blank[-1]) + 1
            else:  # one very long word: go on to its end
                step = end
                while step < len(raw) and not len(blank := np.flatnonzero(_SPACE[raw[step : step + CHUNK]])):
                    step += CHUNK
                end = step + int(blank[0]) + 1 if step < len(raw) else len(raw)
        yield start, end
        start = end


def hash_words(raw, offsets, last_byte=False):
    """(hashes, first): hashes of all words; document d has those from first[d] to first[d + 1].

    With `last_byte` also each word's last byte, A-Z as a-z.
    """
    hashes, begins, lasts = [], [], []
    stops = offsets[:-1]
    for start, end in _chunks(raw):
        b = raw[start:end]
        word = (b != 32) & (b - np.uint8(9) > 4)
        fresh = np.empty(len(b), dtype=bool)
        fresh[0] = True
        np.logical_not(word[:-1], out=fresh[1:])
        own = stops[np.searchsorted(stops, start) : np.searchsorted(stops, end)] - start
        fresh[own] = True
        begin = np.flatnonzero(word & fresh)
        if not len(begin):
            continue
        closes = np.empty(len(b), dtype=bool)
        closes[-1] = True
        np.logical_or(~word[1:], fresh[1:], out=closes[:-1])
        stop = np.flatnonzero(word & closes) + 1
        length = stop - begin
        # bytes are weighted by their place in the chunk; what is before the word is divided out (modulo 2 ** 64)
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(np.take(_BYTES, b, mode="clip") * _powers(len(b), 0), out=total[1:])
        hashes.append(mix((total[stop] - total[begin]) * np.take(_powers(len(b), 1), begin) + length.astype(np.uint64)))
        begins.append(begin + start)
        if last_byte:
            lasts.append(_LOWER[b[stop - 1]])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    first = np.searchsorted(at, offsets)
    if last_byte:
        return h, first, np.concatenate(lasts) if lasts else np.zeros(0, np.uint8)
    return h, first


class Places:
    """Places of hashes in a sorted array of distinct ones, found through their first bits."""

    def __init__(self, hashes):
        self.hashes = hashes
        bits = len(hashes).bit_length() + 2
        self.shift = U64(64 - bits)
        sizes = np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.begins = (np.cumsum(sizes) - sizes).astype(np.int32)
        self.most = int(sizes.max())

    def find(self, hashes):
        """(place, whether it is there) per hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        last = len(self.hashes) - 1
        at = np.minimum(self.begins[(hashes >> self.shift).astype(np.int64)], last).astype(np.int64)
        there = self.hashes[at] == hashes
        left = np.flatnonzero(~there)
        for k in range(1, self.most):
            place = np.minimum(at[left] + k, last)
            hit = self.hashes[place] == hashes[left]
            at[left[hit]], there[left[hit]] = place[hit], True
            left = left[~hit]
        return at, there


def shingle_sets(hashes, first, width):
    """Per document its sorted distinct shingles of `width` words, as 64-bit hashes.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    rolled = hashes
    for k in range(1, width):
        rolled = mix(rolled[:-1] * _BASE + hashes[k:]) if len(rolled) > 1 else rolled[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            one = hashes[a : a + 1]
            for k in range(a + 1, b):
                one = mix(one * _BASE + hashes[k : k + 1])
            yield one
        else:
            yield hashes[:0]


def row_slices(batch, place, limit=4 << 20):
    """Slices of an Arrow batch whose texts (column number `place`) hold about `limit` bytes."""
    _, offsets = text_bytes(batch.column(place))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
