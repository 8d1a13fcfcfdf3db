"""Sampled segmentation into the pieces of a public model, and its inverse.

A text becomes a chain of characters, spaces written as the piece mark, one mark in front. All ways to
cut it into pieces form a lattice. Forward filtering sums the weights of all paths to every position;
backward sampling then draws the pieces from the end, each in proportion to its share. The draw at a
position is a hash of the row's key and the position, so a row always gets the same segmentation,
wherever it is computed.

No piece crosses a mark that follows another character, nor a line break, so the lattice falls apart
into words. The lattice of each distinct word is built once and kept for the next slices of texts, with
array operations over all new words together; draws run over all words of a slice at the same time. A
slice is bounded by its bytes, but a text is never split over slices: one without any white space is a
single lattice, which takes memory in proportion to that text.

Weights: pieces of a merge model carry a rank instead of a probability; a piece of rank r weighs
(r + 2) ** -sharpness. Characters without a piece are spelled in byte pieces, and so is a mark that
stands in the text itself, which keeps decoding lossless.

Cases: NULL texts have NULL pieces and decode to NULL; an empty text has no pieces; rows with NULL keys
share one key; repeated rows get equal segmentations; an empty table gives an empty result. Other
columns are kept or ignored as stated, whatever their names.
"""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .names import free_name
from .words import mix, row_slices

MARK = "▁"
#: stands for a mark of the text itself; no valid text holds a lone surrogate
OWN_MARK = "\udc81"
SLICE_BYTES = 2 << 20
#: arcs kept from slice to slice; words are built anew after that, which changes no draw
MOST_ARCS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
GOLD = np.uint64(0xD1342543DE82EF95)
LOOK_BITS = 16
LOOK_SHIFT = np.uint64(64 - LOOK_BITS)


def _numbered():
    """A dictionary that numbers its keys as they are asked for."""
    return collections.defaultdict(itertools.count().__next__)


class Lattice:
    """Pieces of a model as hash tables by length."""

    def __init__(self, path, sharpness=1.0, seed=0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.seed = np.uint64(seed)
        self.store, self.index = None, _numbered()
        self.byte_ids = np.zeros(256, np.uint32)
        self.raw, self.pieces = [b""] * size, []
        for i in range(size):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = text.replace(MARK, " ").encode()
                self.pieces.append((text, i))
        inner = [p for p, _ in self.pieces if MARK in p.lstrip(MARK) or "\n" in p]
        if inner:
            raise ValueError(f"pieces cross words: {inner[:3]}")
        self.longest = max(len(p) for p, _ in self.pieces)
        self.tables = {}
        for n in range(1, self.longest + 1):
            some = [(self._hash(p), i) for p, i in self.pieces if len(p) == n]
            some.sort()
            self.tables[n] = (np.array([h for h, _ in some], np.uint64), np.array([i for _, i in some], np.int32))
        # where the hashes of pieces, and of what pieces begin with, can lie: most places are ruled out by a look
        self.whole, self.begun = {}, {}
        for n in range(1, self.longest + 1):
            self.whole[n], self.begun[n] = np.zeros(1 << LOOK_BITS, bool), np.zeros(1 << LOOK_BITS, bool)
            self.whole[n][self.tables[n][0] >> LOOK_SHIFT] = True
            begun = {self._hash(b) for b in {p[:n] for p, _ in self.pieces if len(p) > n}}
            self.begun[n][np.array(list(begun), np.uint64) >> LOOK_SHIFT] = True
        self.weight = -sharpness * np.log(np.arange(size) + 2.0)
        self.unknown = -sharpness * np.log(size + 2.0) * 2

    @staticmethod
    def _hash(text):
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def words(self, text):
        """The independent parts of a text, in order; empty parts may occur."""
        if OWN_MARK not in text and MARK in text:
            text = text.replace(MARK, OWN_MARK)
        if "  " in text:
            return re.findall(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+", MARK + text.replace(" ", MARK))
        return (MARK + text).replace(" ", " " + MARK).replace("\n", " \n ").split(" ")

    def build(self, words):
        """Lattice of distinct words: nodes numbered word by word, arcs sorted by their end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        node0 = np.concatenate([[0], np.cumsum(lengths + 1)])
        at_char = np.concatenate([[0], np.cumsum(lengths)])
        total = len(chars)
        left = np.repeat(at_char[1:], lengths) - np.arange(total)
        # 32 bits for what there is one of per arc: less memory to go through
        node = (np.repeat(node0[:-1] - at_char[:-1], lengths) + np.arange(total)).astype(np.int32 if node0[-1] < 1 << 31 else np.int64)
        local = (np.arange(total) - np.repeat(at_char[:-1], lengths)).astype(node.dtype)
        starts, ends, codes, level = [], [], [], []
        h, place = np.zeros(total, np.uint64), np.arange(total)
        for n in range(1, self.longest + 1):
            inside = left[place] >= n
            place, h = place[inside], h[inside]
            if not len(place):
                break
            h = h * BASE + chars[place + n - 1]
            look = h >> LOOK_SHIFT
            keys, ids = self.tables[n]
            maybe = np.flatnonzero(self.whole[n][look])
            at = np.searchsorted(keys, h[maybe])
            at[at == len(keys)] = 0
            same = keys[at] == h[maybe] if len(keys) else np.zeros(0, bool)
            found, code = place[maybe[same]], ids[at[same]]
            if n == 1:
                # negative codes: the character is spelled in bytes
                full = -chars[place].astype(np.int32)
                full[maybe[same]] = code
                found, code = place, full
            starts.append(node[found])
            ends.append(node[found] + n)
            codes.append(code)
            level.append(local[found] + n)
            go = self.begun[n][look]
            place, h = place[go], h[go]
        # long pieces first: they are drawn most often, so that a draw looks at few arcs
        start, end, code, level = (np.concatenate(x[::-1]) for x in (starts, ends, codes, level))
        alpha = np.zeros(node0[-1])
        # runs of ends are sorted already, and levels are small: both stable sorts are cheap
        order = np.argsort(end, kind="stable")
        start, end, code, level = start[order], end[order], code[order], level[order]
        weight = np.where(code >= 0, self.weight[np.maximum(code, 0)], self.unknown)
        top = int(level.max())
        by_level = np.argsort(level.astype(np.uint16) if top < 1 << 16 else level, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(level, minlength=top + 1))])[1:]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < b:
                at = by_level[a:b]
                e = end[at]
                first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
                alpha[e[first]] = np.logaddexp.reduceat(alpha[start[at]] + weight[at], first)
        logp = alpha[start] + weight - alpha[end]
        share = np.exp(logp)
        # running share within the arcs of one end, in [0, 1]; the last is 1 exactly. Added up end by end, so
        # that a word's shares are the same bits whatever words it was built with
        per_end = np.bincount(end, minlength=node0[-1])
        first_arc = np.cumsum(per_end) - per_end
        # a node ends at most one arc per length of a piece
        rank = (np.arange(len(end)) - first_arc[end]).astype(np.uint16)
        within, by_rank = share, np.argsort(rank, kind="stable")
        stops = np.cumsum(np.bincount(rank))
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
            at = by_rank[a:b]
            within[at] += within[at - 1]
        last = np.concatenate([end[1:] != end[:-1], [True]])
        within = np.where(last, 1.0, np.minimum(within, 1.0))
        return node0, lengths, within, start, code, logp, first_arc

    def _add(self, words):
        """Append the lattices of words to the store; their nodes follow those already there."""
        node0, lengths, within, start, code, logp, first_arc = self.build(words)
        kept = self.store
        shift = int(kept["node0"][-1]) if kept else 0
        new = {
            "node0": (node0 + shift)[1 if kept else 0 :], "lengths": lengths, "within": within.astype(np.float32),
            "start": (start + shift).astype(np.int32), "code": code.astype(np.int32), "logp": logp.astype(np.float32),
            "first_arc": (first_arc + (len(kept["code"]) if kept else 0)).astype(np.int32),
        }
        self.store = {k: np.concatenate([kept[k], v]) for k, v in new.items()} if kept else new

    def sample(self, texts, keys):
        """Per text its ids (array) and the log probability of the drawn segmentation."""
        if self.store is None or len(self.store["code"]) > MOST_ARCS:
            self.store, self.index = None, _numbered()
        index, occurrences, counts, known = self.index, [], [], len(self.index)
        for text in texts:
            parts = self.words(text) if text else []
            occurrences += map(index.__getitem__, parts)
            counts.append(len(parts))
        if not occurrences:
            return [np.zeros(0, np.uint32) for _ in texts], np.zeros(len(texts))
        if len(index) > known:
            self._add(list(itertools.islice(index, known, None)))
        lattice = self.store
        word = np.array(occurrences, np.int64)
        doc = np.repeat(np.arange(len(texts)), counts)
        length = lattice["lengths"][word]
        upto = np.cumsum(length)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        doc_start = np.concatenate([[0], upto])[np.minimum(first, len(upto))]
        at = upto - length - doc_start[doc]
        key = mix(keys.astype(np.uint64) * GOLD + self.seed)
        active = np.flatnonzero(length > 0)
        base = lattice["node0"][word]
        now = base + length
        taken, arcs = [], []
        while len(active):
            place = now[active] - base[active] + at[active]
            u = (mix(key[doc[active]] ^ mix(place.astype(np.uint64) + GOLD)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = lattice["first_arc"][now[active]]
            on = np.arange(len(arc))
            while len(on := on[lattice["within"][arc[on]] <= u[on]]):
                arc[on] += 1
            taken.append(active)
            arcs.append(arc)
            now[active] = lattice["start"][arc]
            active = active[now[active] > base[active]]
        taken, arcs, step = np.concatenate(taken), np.concatenate(arcs), np.repeat(np.arange(len(taken)), [len(x) for x in taken])
        # a word's pieces were drawn from its end
        per_word = np.bincount(taken, minlength=len(word))
        slot = np.cumsum(per_word)[taken] - 1 - step
        ordered = np.empty(len(arcs), np.int64)
        ordered[slot] = arcs
        owner = np.repeat(doc, per_word)
        logp = np.bincount(owner, weights=lattice["logp"][ordered], minlength=len(texts))
        ids, owner = self._spelled(lattice["code"][ordered].astype(np.int64), owner)
        stops = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [ids[a:b] for a, b in zip(stops[:-1], stops[1:])], logp

    def _spelled(self, codes, owner):
        """Ids of codes; characters without a piece become the pieces of their bytes."""
        odd = np.flatnonzero(codes < 0)
        if not len(odd):
            return codes.astype(np.uint32), owner
        size = np.ones(len(codes), np.int64)
        raw = []
        for i in odd.tolist():
            char = chr(-codes[i] - 1)
            raw.append((MARK if char == OWN_MARK else char).encode())
            size[i] = len(raw[-1])
        ids = np.repeat(np.maximum(codes, 0), size).astype(np.uint32)
        begin = np.cumsum(size) - size
        for i, b in zip(odd.tolist(), raw):
            ids[begin[i] : begin[i] + len(b)] = self.byte_ids[np.frombuffer(b, np.uint8)]
        return ids, np.repeat(owner, size)

    def decode(self, ids):
        """The text of ids, without the mark in front."""
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]


_LATTICES = {}


def lattice(path, sharpness, seed):
    key = (path, sharpness, seed)
    if key not in _LATTICES:
        _LATTICES[key] = Lattice(path, sharpness, seed)
    return _LATTICES[key]


ENCODED = "ids binary, n_pieces bigint, ids_crc32 bigint, log_prob double, lossless boolean"


def encode_sampled(docs, model_path, doc_id="doc_id", text="text", sharpness=1.0, seed=0, with_ids=True):
    """(doc_id, ids, n_pieces, ids_crc32, log_prob, lossless): one row per row of `docs`.

    `ids` are little-endian unsigned 32-bit bytes, NULL unless `with_ids`. Every segmentation is decoded
    again where it was made; `lossless` says whether that gave the text.
    """

    def work(batches):
        made = lattice(model_path, sharpness, seed)
        for whole in batches:
            for batch in row_slices(whole, 2, SLICE_BYTES):
                texts = batch.column(2).to_pylist()
                ids, logp = made.sample(texts, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
                out = []
                for t, x, p in zip(texts, ids, logp.tolist()):
                    if t is None:
                        out.append((None,) * 5)
                    else:
                        raw = x.astype("<u4").tobytes()
                        out.append((raw if with_ids else None, len(x), zlib.crc32(raw), p, made.decode(x.tolist()) == t))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))],
                    names=["doc_id", "ids", "n_pieces", "ids_crc32", "log_prob", "lossless"],
                )

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id).cast("string")).alias("key"), F.col(text).alias("text")
    )
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(work, f"doc_id {kind}, {ENCODED}")


def decode_pieces(encoded, model_path, ids="ids", decoded="decoded"):
    """`encoded` with the text of its ids in a column named `decoded` (underscores are appended if there is one)."""
    decoded = free_name(decoded, encoded.columns)
    place = encoded.columns.index(ids)
    schema = StructType([*encoded.schema.fields, StructField(decoded, StringType())])

    def work(batches):
        made = lattice(model_path, 1.0, 0)
        for batch in batches:
            texts = [None if x is None else made.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return encoded.mapInArrow(work, schema)
