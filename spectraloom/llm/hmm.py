"""Language-model scoring: a hidden Markov model over words, and add-one unigrams beside it.

Words are counted over all training documents. The most frequent, at most `K`, are symbols that every task
knows (words of about equal counts together or not at all). Every other word is a symbol by its last byte
while the states are learned, and then gets a distribution over states of its own: expected counts per word and
state stay a Spark table, which grows with the corpus and meets the texts by a join on the word. So

    P(word | state) = P(class | state) * (c + 1) * tilt(word, state) / mass(class, state)

where tilt is the word's share of the state over its class's, from 1/16 to 14 in steps of a quarter of a factor of
two (five bits per state, one number per word), and mass sums the numerator over the class and one unknown word of tilt 1: the words of a state add up to
1. No word list is broadcast beyond the `K` frequent ones, and in scoring the `NEAR` next (at most: words of equal
counts together or not at all), which spares the join most of its rows. Both ways give the same scores.

Training is Baum-Welch over windows of `WINDOW` tokens of whole texts. The first window of a text starts from
the start shares, any other from shares of its own; the last one is as long as the rest of the text. The
moves over window edges (one in `WINDOW`) are not counted. Expected counts travel with 16 significant bits (of rare words: in 64ths). Each of `SLICES` rounds sees another slice of all
windows of all texts, dealt by hash, then `ROUNDS` rounds see all of them; the last also sums the counts
per rare word and state. Each task sums its expected counts, Spark adds them up, and the driver gets one
row per symbol (at most 65,536) per round. The score of a text is its exact likelihood: the forward
recursion over the whole text, rescaled at every token.

Texts are encoded once (two bytes a token) and written to the shared folder; rounds read that table.

Cases: a NULL text is empty and has its end token only; rows without an id are scored and never learned
from; repeated rows count each and are scored each; without training rows all symbols are equally likely;
an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from spectraloom.session import scratch_path

from .words import Places, hash_words, mix, row_slices, text_bytes

SYMBOLS = 1 << 16
K = SYMBOLS - 257
STATES = 12
ROUNDS = 3
WINDOW = 256
SLICES = 8
SMOOTH = 20.0
BLOCK_TOKENS = 1 << 18
#: tokens whose emissions a step of scoring looks up together
STEP_TOKENS = 1 << 16
COUNT_TOKENS = 4_000_000
#: rare words whose expected counts a task holds before it passes them on
HELD_TAIL = 1 << 18
#: a rare word's shares lean on its class as if it had been seen so many times more
LEAN = 2.0
#: a tilt's steps to a factor of two, and its bits
STEP = 4.0
BITS = 5
HALF = 1 << (BITS - 1)
#: rare words that scoring tasks know at most
NEAR = 1 << 16
#: partitions that a task of a round over all windows takes: fewer tasks send fewer sums
TOGETHER = 2


def words_of(column):
    """(keys, first): a word's key is its hash with the last byte of the word in the low eight bits."""
    h, first, last = hash_words(*text_bytes(column), last_byte=True)
    return (h & ~np.uint64(255)) | last.astype(np.uint64), first


def word_counts(docs):
    """(key, c) over the texts of `docs`: summed per task, then over tasks."""

    def work(batches):
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))], names=["key", "c"]
                )

        for whole in batches:
            for batch in row_slices(whole, 0):
                keys, _ = words_of(batch.column(0))
                held.append(keys)
                size += len(keys)
                if size > COUNT_TOKENS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(work, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What tasks need to know of the counts: bounded by the number of symbols."""

    def __init__(self, head, tokens, types, documents, class_tokens):
        keys = np.array([r.key for r in head], dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.tokens, self.types = tokens, types
        self.counts = np.zeros(SYMBOLS)
        self.counts[0] = documents
        self.counts[1 : 1 + len(keys)] = np.array([r.c for r in head], dtype=float)[order]
        self.counts[1 + K :] = class_tokens
        self.log_head = np.log10(self.counts + 1)

    def places(self):
        return Places(self.keys)

    def symbols(self, keys, places=None):
        at, there = (places or self.places()).find(keys)
        return np.where(there, at + 1, (keys & np.uint64(255)).astype(np.int64) + 1 + K), ~there

    def unigram(self):
        """Smoothed shares of the symbols that can occur."""
        share = self.counts + 0.5
        share[1 + len(self.keys) : 1 + K] = 0
        return share / share.sum()


def _level(count):
    """Bins of counts, 64 to a factor of two: their number does not grow with the words."""
    return F.floor(F.log2(count) * 64).cast("int")


def _lowest(sizes, most):
    """The lowest bin from which on upwards there are at most `most` words."""
    limit, fits = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        if fits + sizes[k] > most:
            break
        limit, fits = k, fits + sizes[k]
    return limit


def learn_vocabulary(counts, documents, most=K):
    row = counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens")).first()
    # frequent words are those from a bin of counts upwards that fit: no task sends its own K words
    level = _level("c")
    limit = _lowest({r.level: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}, most)
    head = counts.filter(level >= limit).collect()
    class_tokens = np.zeros(256)
    rest = counts.filter(level < limit).groupBy(F.col("key").bitwiseAND(F.lit(255)).alias("b"))
    for r in rest.agg(F.sum("c").alias("c")).collect():
        class_tokens[r.b] = r.c
    return Vocabulary(head, row.tokens + documents, row.types + (documents > 0), documents, class_tokens)


ENCODED = "row bigint, doc_id bigint, held_out boolean, learn boolean, n_tokens bigint, symbols binary, tail binary"


def encode(docs, vocabulary):
    """Texts as symbols (little-endian 16-bit, end token included) and the keys of words without own symbol."""

    def work(batches):
        row, places = TaskContext.get().partitionId() << 40, vocabulary.places()
        for whole in batches:
            for batch in row_slices(whole, 3):
                keys, first = words_of(batch.column(3))
                symbols, tail = vocabulary.symbols(keys, places)
                texts, tails = [], []
                for a, b in zip(first[:-1], first[1:]):
                    texts.append(symbols[a:b].astype("<u2").tobytes() + b"\0\0")
                    tails.append(keys[a:b][tail[a:b]].astype("<u8").tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), batch.column(2),
                        pa.array(np.diff(first).astype(np.int64) + 1), pa.array(texts, pa.binary()), pa.array(tails, pa.binary()),
                    ],
                    names=[c.split()[0] for c in ENCODED.split(", ")],
                )
                row += n

    return docs.select("doc_id", "held_out", "learn", "text").mapInArrow(work, ENCODED)


class Model:
    """Start shares of texts and of later windows, transitions, emissions (symbols x states, single precision)."""

    def __init__(self, start, go, moves, emit):
        self.start, self.go, self.moves, self.emit = (np.ascontiguousarray(x, dtype=np.float32) for x in (start, go, moves, emit))

    @classmethod
    def first(cls, unigram, states=STATES, seed=3):
        rnd = np.random.default_rng(seed)
        emit = unigram[:, None] * rnd.gamma(0.7, size=(SYMBOLS, states))
        moves = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        even = np.full(states, 1 / states)
        return cls(even, even, moves, emit / emit.sum(axis=0))

    @classmethod
    def updated(cls, sums, unigram):
        """From expected counts; each state's emissions lean on the unigram."""
        emit = sums.emit + SMOOTH * unigram[:, None]
        moves, start, go = sums.moves + 1.0, sums.start + 1.0, sums.go + 1.0
        return cls(start / start.sum(), go / go.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Sums:
    """Expected counts."""

    def __init__(self, states):
        self.start, self.go = np.zeros(states), np.zeros(states)
        # a state's emissions side by side: they are added to state by state
        self.moves, self.emit = np.zeros((states, states)), np.zeros((states, SYMBOLS)).T

    def rows(self):
        """(ids, values): symbols that occurred, and the other counts under negative ids."""
        s = len(self.start)
        used = np.flatnonzero(self.emit.any(axis=1))
        return np.concatenate([np.arange(-s - 2, 0), used]), np.concatenate([self.moves, self.start[None], self.go[None], self.emit[used]])

    @classmethod
    def of(cls, ids, values, states):
        out = cls(states)
        for i, v in zip(ids[ids < 0], values[ids < 0]):
            place = i + states + 2
            if place < states:
                out.moves[place] = v
            elif place == states:
                out.start = v
            else:
                out.go = v
        out.emit[ids[ids >= 0]] = values[ids >= 0]
        return out


def expected_counts(model, windows, lengths, first, sums):
    """Adds the expected counts of windows (rows of symbols, longest first, followed by any symbols).

    Returns the log likelihood and, per place and window, the shares of the states (zero beyond a window's end).
    """
    n, size = windows.shape
    s = len(model.start)
    active = np.searchsorted(-lengths, -np.arange(size), side="left")
    alpha = np.zeros((size, n, s), dtype=np.float32)
    flat = windows.T.ravel().astype(np.intp)
    e = np.take(model.emit, flat, axis=0).reshape(size, n, s)
    scale = np.ones((size, n, 1), dtype=np.float32)
    a = np.where(first[:, None], model.start, model.go)
    for t in range(size):
        k = active[t]
        a = (a[:k] @ model.moves if t else a[:k]) * e[t, :k]
        np.sum(a, axis=1, keepdims=True, out=scale[t, :k])
        a = np.divide(a, scale[t, :k], out=alpha[t, :k])
    beta = np.ones((n, s), dtype=np.float32)
    for t in range(size - 1, -1, -1):
        if t < size - 1:
            # beta of t + 1, weighted by its emission; windows that end at t have ones
            k = active[t + 1]
            out = beta[:k] * e[t + 1, :k] / scale[t + 1, :k]
            sums.moves += (alpha[t, :k].T @ out) * model.moves
            beta[:k] = out @ model.moves.T
        alpha[t] *= beta
    sums.start += alpha[0][first].sum(axis=0)
    sums.go += alpha[0][~first].sum(axis=0)
    del e
    # columns are laid side by side at once: one by one, each would read all of alpha
    gamma = np.ascontiguousarray(alpha.reshape(-1, s).T, dtype=np.float64)
    for k in range(s):
        sums.emit[:, k] += np.bincount(flat, weights=gamma[k], minlength=SYMBOLS)
    return float(np.log(scale).sum()), alpha


def blocks_of(numbers, texts, keys=None, part=None):
    """(windows, lengths, first, keys) of texts given as row numbers, symbols and keys of rare words, in blocks of bounded size.

    With `part`, only the windows that hash to this slice of `SLICES`. `keys`, if given, are those of the symbols
    beyond `K`, window by window.
    """
    sizes = np.array([len(x) for x in texts])
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * WINDOW
    if part is not None:
        hashed = mix(mix(np.asarray(numbers).astype(np.uint64)[owner]) + place.astype(np.uint64))
        chosen = hashed % np.uint64(SLICES) == np.uint64(part)
        owner, place = owner[chosen], place[chosen]
    if not len(owner):
        return
    begin = np.cumsum(sizes) - sizes
    flat = np.concatenate([*texts, np.zeros(WINDOW, np.uint16)])
    length = np.minimum(WINDOW, sizes[owner] - place)
    at = begin[owner] + place
    rare = np.concatenate([[0], np.cumsum(flat > K)]) if keys is not None else None
    order = np.argsort(-length, kind="stable")
    start = 0
    while start < len(order):
        # as many windows as fit, of about one length: longest first
        rows = order[start : start + max(BLOCK_TOKENS // int(length[order[start]]), 1)]
        start += len(rows)
        windows = flat[at[rows][:, None] + np.arange(length[rows[0]])]
        found = None
        if keys is not None:
            low = rare[at[rows]]
            n = rare[at[rows] + length[rows]] - low
            found = keys[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        yield windows, length[rows], place[rows] == 0, found


def shortened(values):
    """Rounded to 16 significant bits: what is summed up over tasks compresses well."""
    bits = np.ascontiguousarray(values, dtype=np.float32).view(np.uint32)
    return ((bits + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32).astype(np.float64)


def round_counts(encoded, model, part=None, tails=False):
    """(tail, id, n, s0, ...): expected counts of one round, added up over tasks.

    Rows with `tail` false are those of `Sums.rows`; with `tails`, there is one per rare word too: its key as
    id, its number of occurrences, its counts per state.
    """
    s = len(model.start)
    names = ["tail", "id", "n", *(f"s{k}" for k in range(s))]

    def emitted(tail, ids, n, values):
        values = np.round(values * 64) / 64 if tail else shortened(values)
        for i in range(0, len(ids), 10_000):
            j = slice(i, i + 10_000)
            columns = [pa.array(np.full(len(ids[j]), tail)), pa.array(ids[j].astype(np.int64)), pa.array(n[j].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(values[j, k]) for k in range(s)], names=names)

    def work(batches):
        sums, some, held, size = Sums(s), False, [], 0

        def flush():
            keys, at, n = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True, return_counts=True)
            shares = np.concatenate([g for _, g in held])
            held.clear()
            yield from emitted(True, keys.view(np.int64), n, np.stack([np.bincount(at, shares[:, k], len(keys)) for k in range(s)], axis=1))

        for whole in batches:
            for batch in row_slices(whole, 1, 8 << 20):
                texts = [np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()]
                rare = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8") if tails else None
                for windows, lengths, first, keys in blocks_of(batch.column(0).to_numpy(), texts, rare, part):
                    some = True
                    _, gamma = expected_counts(model, windows, lengths, first, sums)
                    if tails and len(keys):
                        i, t = np.nonzero((windows > K) & (np.arange(windows.shape[1]) < lengths[:, None]))
                        held.append((keys, gamma[t, i]))
                        size += len(keys)
                        if size >= HELD_TAIL:
                            yield from flush()
                            size = 0
        if held:
            yield from flush()
        if some:
            ids, values = sums.rows()
            yield from emitted(False, ids, np.zeros(len(ids), np.int64), values)

    schema = "tail boolean, id bigint, n bigint, " + ", ".join(f"{c} double" for c in names[3:])
    rows = encoded.filter("learn").select("row", "symbols", *(["tail"] if tails else []))
    tasks = -(-rows.rdd.getNumPartitions() // (TOGETHER if part is None else SLICES))
    rows = rows.coalesce(max(tasks, 1)).mapInArrow(work, schema)
    return rows.groupBy("tail", "id").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _sums(rows, states):
    found = rows.filter("not tail").toPandas()
    return Sums.of(found["id"].to_numpy(), found[[f"s{k}" for k in range(states)]].to_numpy(dtype=float), states)


def train(encoded, vocabulary, states=STATES, rounds=ROUNDS):
    """(model, expected counts of its last round with those of rare words, in a stored table)."""
    unigram = vocabulary.unigram()
    model = Model.first(unigram, states)
    for part in range(SLICES):
        model = Model.updated(_sums(round_counts(encoded, model, part), states), unigram)
    for k in range(rounds):
        last = k == rounds - 1
        counts = round_counts(encoded, model, tails=last)
        counts = _stored(counts, "round") if last else counts
        sums = _sums(counts, states)
        model = Model.updated(sums, unigram)
    return model, sums, counts.filter("tail").drop("tail")


class Tails:
    """Rare words: `table` (key, c, tilt) and `mass` (class x state), the sum of their numerators and an unknown word's."""

    def __init__(self, counts, sums, states, near=NEAR):
        if BITS * states > 62:
            raise ValueError(f"a word's tilts have room for {62 // BITS} states")
        shares = sums.emit[1 + K :] + 1e-9
        shares = shares / shares.sum(axis=1, keepdims=True)

        def work(batches):
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                own = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(states)], axis=1)
                usual = shares[keys & 255]
                ratio = (own + LEAN * usual) / (own.sum(axis=1, keepdims=True) + LEAN) / usual
                steps = np.clip(np.round(np.log2(ratio) * STEP), -HALF, HALF - 1).astype(np.int64) + HALF
                tilt = (steps << (BITS * np.arange(states))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tilt)], names=["key", "c", "tilt"])

        def masses(batches):
            out = np.zeros((256, states))
            for batch in batches:
                if batch.num_rows:
                    numerator = numerators(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)), states)
                    np.add.at(out, batch.column(0).to_numpy(zero_copy_only=False) & 255, numerator)
            some = np.flatnonzero(out.any(axis=1))
            if len(some):
                columns = [pa.array(some.astype(np.int32)), *(pa.array(out[some, k]) for k in range(states))]
                yield pa.RecordBatch.from_arrays(columns, names=["b", *(f"m{k}" for k in range(states))])

        columns = ["id", "n", *(f"s{k}" for k in range(states))]
        self.table = _stored(counts.select(*columns).mapInArrow(work, "key bigint, c bigint, tilt bigint"), "tails")
        # the most frequent of them as sorted arrays; 24 bytes each
        sizes = {r.level: r["count"] for r in self.table.groupBy(_level("c").alias("level")).count().collect()}
        limit = _lowest(sizes, near)
        known = self.table.filter(_level("c") >= limit).toPandas()
        order = np.argsort(known["key"].to_numpy(np.int64).view(np.uint64))
        self.near = [known[c].to_numpy(np.int64)[order] for c in ("key", "c", "tilt")]
        self.far = self.table.filter(_level("c") < limit)
        m = [f"m{k}" for k in range(states)]
        added = self.table.mapInArrow(masses, "b int, " + ", ".join(f"{c} double" for c in m)).groupBy("b").agg(*[F.sum(c).alias(c) for c in m])
        self.mass = np.ones((256, states))
        for r in added.collect():
            self.mass[r.b] += [r[c] for c in m]


def numerators(counts, tilts, states):
    """(c + 1) * tilt per word and state."""
    steps = tilts[:, None] >> (BITS * np.arange(states)) & (2 * HALF - 1)
    return (counts + 1.0)[:, None] * np.exp2((np.arange(2 * HALF) - HALF) / STEP)[steps]


def forward(model, sequences, rare=None, factors=None):
    """Natural log likelihood of every sequence.

    `rare` has for every sequence, place by place, the row of `factors` (words x states) that its emission is
    multiplied by, or -1.
    """
    if not len(sequences):
        return np.zeros(0)
    lengths = np.array([len(x) for x in sequences])
    return forward_flat(model, np.concatenate(sequences), lengths, None if rare is None else np.concatenate(rare), factors)


def forward_flat(model, symbols, lengths, rare=None, factors=None):
    """The same of sequences that lie one after the other: all in step, longest first."""
    total = np.zeros(len(lengths))
    if not len(lengths):
        return total
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
    ends = np.cumsum(active)
    a = np.broadcast_to(model.start, (len(order), len(model.start)))
    low = 0
    while low < len(active):
        # emissions of as many steps as fit, step by step and sequence by sequence
        before = ends[low] - active[low]
        high = max(int(np.searchsorted(ends, before + STEP_TOKENS, side="right")), low + 1)
        n = active[low:high]
        first = ends[low:high] - n - before
        which = np.arange(ends[high - 1] - before) - np.repeat(first, n)
        at = begins[which] + np.repeat(np.arange(low, high), n)
        e = np.take(model.emit, symbols[at], axis=0)
        if rare is not None:
            odd = rare[at]
            some = np.flatnonzero(odd >= 0)
            e[some] *= factors[odd[some]]
        scale = np.empty((len(e), 1), dtype=np.float32)
        for t, i, k in zip(range(low, high), first.tolist(), n.tolist()):
            now, sums = e[i : i + k], scale[i : i + k]
            np.multiply(a[:k] @ model.moves if t else a[:k], now, out=now)
            np.sum(now, axis=1, keepdims=True, out=sums)
            a = np.divide(now, sums, out=now)
        total[: n[0]] += np.bincount(which, weights=np.log(scale[:, 0], dtype=np.float64))
        low = high
    out = np.empty(len(order))
    out[order] = total
    return out


class Fitted:
    """All that scoring needs: encoded rows, vocabulary, model and rare words."""

    def __init__(self, rows, states=STATES, rounds=ROUNDS, most=K, near=NEAR):
        counts = _stored(word_counts(rows.filter("learn")), "counts")
        self.vocabulary = learn_vocabulary(counts, rows.filter("learn").count(), most)
        self.encoded = _stored(encode(rows, self.vocabulary), "encoded")
        self.model, sums, tails = train(self.encoded, self.vocabulary, states, rounds)
        self.tails = Tails(tails, sums, states, near)


def prepared(docs, doc_id="doc_id", text="text", modulus=7, held=2):
    """(doc_id, held_out, learn, text) of a table of documents."""
    rest = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(rest == held, F.lit(False)).alias("held_out"),
        F.coalesce(rest != held, F.lit(False)).alias("learn"), F.col(text).alias("text"),
    )


def score_documents(docs, doc_id="doc_id", text="text", modulus=7, held=2, states=STATES, rounds=ROUNDS):
    """One row per row of `docs`: counts, the unigram score and the model's log10 probability of the text."""
    return score(Fitted(prepared(docs, doc_id, text, modulus, held), states, rounds))


def distinct_keys(tails):
    """(keys, text, first, which): per text its distinct rare words in order, text by text.

    Text d has those from first[d] to first[d + 1]; `which` has for every occurrence the place of its word in `keys`.
    """
    raw = np.frombuffer(b"".join(tails), "<u8")
    owner = np.repeat(np.arange(len(tails)), [len(x) // 8 for x in tails])
    order = np.lexsort((raw, owner))
    keys, text = raw[order], owner[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    which = np.empty(len(keys), dtype=np.int64)
    which[order] = np.cumsum(fresh) - 1
    keys, text = keys[fresh], text[fresh]
    return keys, text, np.searchsorted(text, np.arange(len(tails) + 1)), which


def score(fitted):
    vocabulary, model, mass = fitted.vocabulary, fitted.model, fitted.tails.mass
    near, near_counts, near_tilts = fitted.tails.near
    near = near.view(np.uint64)
    size, states = float(np.log10(vocabulary.tokens + vocabulary.types + 1)), len(model.start)

    def split(batches):
        places = Places(near)
        for whole in batches:
            for batch in row_slices(whole, 1, 1 << 20):
                keys, text, first, _ = distinct_keys(batch.column(1).to_pylist())
                far = np.flatnonzero(~places.find(keys)[1])
                if len(far):
                    text = text[far]
                    columns = [batch.column(0).take(pa.array(text)), pa.array(keys[far].view(np.int64)), pa.array((far - first[text]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "place"])

    # the other rare words of every text, as places in the order of its rare words, with what the corpus says of them
    used = fitted.encoded.select("row", "tail").mapInArrow(split, "row bigint, key bigint, place int")
    used = used.join(fitted.tails.far, "key").groupBy("row").agg(F.collect_list(F.struct("place", "c", "tilt")).alias("known"))
    rows = fitted.encoded.select("row", "doc_id", "held_out", "n_tokens", "symbols", "tail").join(used, "row", "left")

    def factors_of(keys, numerator):
        return (numerator / mass[(keys & np.uint64(255)).astype(np.int64)]).astype(np.float32)

    def work(batches):
        places, near_factors = Places(near), factors_of(near, numerators(near_counts, near_tilts, states))
        for whole in batches:
            for batch in row_slices(whole, 3, 1 << 20):
                n = batch.column(2).to_numpy()
                symbols = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2")
                keys, text, first, which = distinct_keys(batch.column(4).to_pylist())
                counts, factors = np.zeros(len(keys)), factors_of(keys, np.ones((len(keys), states)))
                found, is_near = places.find(keys)
                counts[is_near], factors[is_near] = near_counts[found[is_near]], near_factors[found[is_near]]
                words = batch.column(5)
                place, c, tilt = (pc.struct_field(words.flatten(), f).to_numpy(zero_copy_only=False) for f in ("place", "c", "tilt"))
                if len(place):
                    place = place + np.repeat(first[:-1], pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False))
                    counts[place], factors[place] = c, factors_of(keys[place], numerators(c, tilt, states))
                is_rare = symbols > K
                rare = np.full(len(symbols), -1)
                rare[is_rare] = which
                owner = np.repeat(np.arange(len(n)), n)

                def added(frequent, tail):
                    """Summed per text: a value per symbol, for words with one of their own, and a value per rare word."""
                    each = frequent[symbols]
                    each[is_rare] = tail[which]
                    return np.bincount(owner, weights=each, minlength=len(n))

                base = added(vocabulary.log_head, np.log10(counts + 1)) - n * size
                n_known = added(vocabulary.counts > 0, counts > 0).astype(np.int64)
                likely = forward_flat(model, symbols, n, rare, factors) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(n_known), pa.array(base), pa.array(likely)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = rows.select("doc_id", "held_out", "n_tokens", "symbols", "tail", "known").mapInArrow(
        work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(vocabulary.tokens)).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


def _stored(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
