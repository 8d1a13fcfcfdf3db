"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows of `STEPS`. Two recurrent layers read each window, one from
either side; at every byte a softmax over both states gives a probability per language. A document's
probabilities are the means over all its bytes, so the whole text counts.

The network is trained on the driver, in numpy, by backpropagation through time and Adam, on a bounded
sample: about `TRAIN_DOCS` labelled documents per language, drawn by a hash of the id, and at most
`WINDOWS_PER_DOC` windows from places drawn all over each text. Gates use x / (1 + |x|), which is as
smooth as needed and much cheaper than exponentials.

Cases: NULL texts and texts without a letter are `und` with score 0, and so is everything if no row can
be learned from; rows with NULL language or id are predicted and not learned from; repeated rows get the
same answer; ties go to the language first in order; an empty table gives an empty result. Other columns
are ignored, whatever their names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .words import row_slices, text_bytes

STEPS = 64
HIDDEN = 8
TRAIN_DOCS = 300
WINDOWS_PER_DOC = 8
UPDATES = 220
BATCH = 192
RATE = 0.02
BLOCK = 4096


def soft(x):
    return x / (1 + np.abs(x))


class Network:
    """Parameters by name; arrays are features x batch, so that rows are contiguous."""

    def __init__(self, languages, hidden=HIDDEN, seed=5):
        rnd = np.random.default_rng(seed)
        n = len(languages)
        self.languages, self.hidden = list(languages), hidden
        small = lambda *shape: rnd.normal(0, 0.3, shape).astype(np.float32)
        self.p = {
            "in_f": small(3 * hidden, 256), "in_b": small(3 * hidden, 256),
            "rec_f": small(hidden, 3 * hidden), "rec_b": small(hidden, 3 * hidden),
            "out": small(n, 2 * hidden), "bias": np.zeros((n, 1), np.float32),
        }

    def step(self, side, x, h):
        """One gated step for bytes x; also what backpropagation needs."""
        k = self.hidden
        a = self.p["in_" + side][:, x]
        m = self.p["rec_" + side].T @ h
        gates = 0.5 + 0.5 * soft(a[: 2 * k] + m[: 2 * k])
        z, r, q = gates[:k], gates[k:], m[2 * k :]
        n = soft(a[2 * k :] + r * q)
        return n + z * (h - n), (h, z, r, q, n)

    def states(self, side, windows, keep=None):
        """States after every byte; windows: steps x batch."""
        steps, size = windows.shape
        h = np.zeros((self.hidden, size), np.float32)
        out = np.empty((steps, self.hidden, size), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            h, memory = self.step(side, windows[t], h)
            out[t] = h
            if keep is not None:
                keep[t] = memory
        return out

    def probabilities(self, both):
        logits = self.p["out"] @ both + self.p["bias"]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=0)

    def window_sums(self, windows, lengths):
        """Sum over the first `lengths` bytes of each window of the probabilities: batch x languages."""
        forward, backward = self.states("f", windows), self.states("b", windows)
        total = np.zeros((len(self.languages), windows.shape[1]), np.float32)
        for t in range(windows.shape[0]):
            p = self.probabilities(np.concatenate([forward[t], backward[t]]))
            total += p * (lengths > t)
        return total.T

    def gradients(self, windows, lengths, labels):
        """Mean cross entropy over all labelled bytes, and its gradients."""
        k, (steps, size) = self.hidden, windows.shape
        keep = {"f": {}, "b": {}}
        out = {s: self.states(s, windows, keep[s]) for s in "fb"}
        grad = {name: np.zeros_like(v) for name, v in self.p.items()}
        used, loss = float(lengths.sum()), 0.0
        from_out = {s: np.empty_like(out[s]) for s in "fb"}
        for t in range(steps):
            both = np.concatenate([out["f"][t], out["b"][t]])
            p = self.probabilities(both)
            on = (lengths > t).astype(np.float32)
            loss -= float((np.log(p[labels, np.arange(size)] + 1e-12) * on).sum())
            p[labels, np.arange(size)] -= 1
            p *= on / used
            grad["out"] += p @ both.T
            grad["bias"] += p.sum(axis=1, keepdims=True)
            d = self.p["out"].T @ p
            from_out["f"][t], from_out["b"][t] = d[:k], d[k:]
        for s in "fb":
            dh = np.zeros((k, size), np.float32)
            inputs = np.empty((steps, 3 * k, size), np.float32)
            for t in range(steps - 1, -1, -1) if s == "f" else range(steps):
                h, z, r, q, n = keep[s][t]
                dh = dh + from_out[s][t]
                d_n = dh * (1 - z) * (1 - np.abs(n)) ** 2
                d_z = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                d_r = d_n * q * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                d_m = np.concatenate([d_z, d_r, d_n * r])
                inputs[t] = np.concatenate([d_z, d_r, d_n])
                grad["rec_" + s] += h @ d_m.T
                dh = dh * z + self.p["rec_" + s] @ d_m
            flat = windows.ravel()
            for row in range(3 * k):
                grad["in_" + s][row] = np.bincount(flat, weights=inputs[:, row].ravel(), minlength=256)
        return loss / used, grad


def windows_of(raw, steps=STEPS):
    """(windows as steps x count, bytes in each): consecutive windows of one text, the last one padded."""
    count = -(-len(raw) // steps)
    padded = np.zeros(count * steps, np.uint8)
    padded[: len(raw)] = raw
    lengths = np.full(count, steps)
    if count:
        lengths[-1] = len(raw) - (count - 1) * steps
    return padded.reshape(count, steps).T, lengths


def fit(samples, updates=UPDATES, batch=BATCH, seed=1):
    """A network from rows (language, window bytes); None without rows."""
    samples = sorted((lang, bytes(raw)) for lang, raw in samples if len(raw))
    if not samples:
        return None
    languages = sorted({lang for lang, _ in samples})
    network = Network(languages)
    windows = np.zeros((STEPS, len(samples)), np.uint8)
    for i, (_, raw) in enumerate(samples):
        windows[: len(raw), i] = np.frombuffer(raw, np.uint8)
    lengths = np.array([len(raw) for _, raw in samples])
    labels = np.array([languages.index(lang) for lang, _ in samples])
    by_language = [np.flatnonzero(labels == i) for i in range(len(languages))]
    rnd = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    for step in range(1, updates + 1):
        # languages take equal parts of every batch
        pick = np.concatenate([rnd.choice(at, -(-batch // len(languages))) for at in by_language])
        _, grad = network.gradients(windows[:, pick], lengths[pick], labels[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * (1 - step / (updates + 1))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            network.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return network


def document_probabilities(network, raw, offsets):
    """documents x languages: means over the bytes of each text, zeros for empty ones."""
    sizes = np.diff(offsets)
    counts = -(-sizes // STEPS)
    owner = np.repeat(np.arange(len(sizes)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.repeat(offsets[:-1], counts) + STEPS * (np.arange(len(owner)) - begin[owner])
    lengths = np.minimum(STEPS, np.repeat(offsets[1:], counts) - at)
    total = np.zeros((len(sizes), len(network.languages)))
    padded = np.concatenate([raw, np.zeros(STEPS, np.uint8)])
    for i in range(0, len(owner), BLOCK):
        part = at[i : i + BLOCK]
        windows = padded[np.arange(STEPS)[:, None] + part[None, :]]
        windows *= np.arange(STEPS)[:, None] < lengths[i : i + BLOCK]
        sums = network.window_sums(windows, lengths[i : i + BLOCK])
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(owner[i : i + BLOCK], weights=sums[:, k], minlength=len(sizes))
    return total / np.maximum(sizes, 1)[:, None]


def training_windows(docs, doc_id, text, lang, learn):
    """(lang, window) rows of a bounded sample of `docs`."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(doc_id).cast("string"), F.lit("sample")).alias("h"), F.col(text).alias("text")
    )
    sizes = rows.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(2.0 * TRAIN_DOCS) / F.col("count"))
    near = rows.join(F.broadcast(sizes), "lang").filter(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    first = Window.partitionBy("lang").orderBy("h", "text")
    near = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= TRAIN_DOCS)

    def work(batches):
        for batch in batches:
            langs, out = [], []
            for name, h, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = value.encode()
                rnd = np.random.default_rng(h & (2**63 - 1))
                starts = [0] if len(raw) <= STEPS else rnd.integers(0, len(raw) - STEPS + 1, min(WINDOWS_PER_DOC, len(raw) // STEPS))
                langs += [name] * len(starts)
                out += [raw[s : s + STEPS] for s in starts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(out, pa.binary())], names=["lang", "window"])

    return near.select("lang", "h", "text").mapInArrow(work, "lang string, window binary")


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double"


def predict_languages(docs, doc_id="doc_id", text="text", lang="lang", modulus=4, held=2):
    """One row per row of `docs`: id, whether it is held out, predicted language and its probability."""
    rest = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))
    samples = training_windows(docs, doc_id, text, lang, F.coalesce(rest != held, F.lit(False))).collect()
    network = fit([(r.lang, r.window) for r in samples])

    def work(batches):
        for whole in batches:
            for batch in row_slices(whole, 2):
                texts = batch.column(2).to_pylist()
                lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                if network is not None:
                    p = document_probabilities(network, *text_bytes(batch.column(2)))
                    for i, best in enumerate(p.argmax(axis=1)):
                        if lettered[i]:
                            names[i], scores[i] = network.languages[best], min(1.0, float(p[i, best]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[c.split()[0] for c in PREDICTED.split(", ")],
                )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(rest == held, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(work, PREDICTED)
