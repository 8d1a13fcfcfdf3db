import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, window string, h string, n int, source string"
SMALLEST = "/root/testdata/sf0.001"


def test_gradients_equal_finite_differences():
    rnd = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, labels = rnd.integers(0, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    lengths = np.array([7, 7, 3, 1, 7])
    _, grad = net.gradients(windows, lengths, labels)
    for name, value in net.p.items():
        places = [(r, c) for r in range(value.shape[0]) for c in range(value.shape[1])]
        used = [p for p in places if abs(grad[name][p]) > 1e-6]
        for p in [used[i] for i in rnd.permutation(len(used))[:6]]:
            value[p] += 1e-4
            up = net.gradients(windows, lengths, labels)[0]
            value[p] -= 2e-4
            down = net.gradients(windows, lengths, labels)[0]
            value[p] += 1e-4
            # states are kept in single precision
            assert (up - down) / 2e-4 == pytest.approx(grad[name][p], rel=0.05, abs=2e-3)


def test_pooling_equals_window_by_window():
    net = langid.Network(["x", "y"])
    texts = [b"", b"short", b"q" * 64, bytes(range(1, 200)) * 3]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = langid.document_probabilities(net, raw, offsets)
    for i, text in enumerate(texts):
        windows, lengths = langid.windows_of(np.frombuffer(text, np.uint8))
        want = net.window_sums(windows, lengths).sum(axis=0) / max(len(text), 1)
        assert got[i] == pytest.approx(want, abs=1e-4)
        assert got[i].sum() == pytest.approx(1.0 if text else 0.0, abs=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict_languages(docs).collect()
    assert {r.doc_id for r in got} == set(truth) and len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_nulls_ties_repeats_and_clashing_names(spark):
    good = spark.read.parquet(f"{SMALLEST}/documents.parquet").select("text", "lang").limit(60).collect()
    rows = [(i, r.text, r.lang, "a", "b", 1, "c") for i, r in enumerate(good)]
    rows += [(500, None, "en", *"ab", 1, "c"), (501, "", "en", *"ab", 1, "c"), (502, "12 !? \U0001f600", None, *"ab", 1, "c")]
    rows += [(503, good[0].text, None, *"ab", 1, "c"), (None, good[0].text, "zz", *"ab", 1, "c"), (503, good[0].text, None, *"ab", 1, "c")]
    rows += [(504, "word " * 30000, "en", *"ab", 1, "c")]
    got = langid.predict_languages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (500, 501, 502))
    assert by_id[503].lang_pred == by_id[None].lang_pred == by_id[0].lang_pred and by_id[None].held_out is False
    assert not any(r.lang_pred == "zz" for r in got)


def test_nothing_to_learn_from(spark):
    rows = [(1, "text", None, "a", "b", 1, "c")]
    assert [tuple(r)[2:] for r in langid.predict_languages(spark.createDataFrame(rows, SCHEMA)).collect()] == [("und", 0.0)]
    assert langid.predict_languages(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_states(p, side, window):
    """The recurrent network byte by byte, written out gate by gate in double precision."""
    soft = lambda x: x / (1 + abs(x))
    w, u = p["in_" + side].astype(float), p["rec_" + side].astype(float)
    k, out = len(u), [None] * len(window)
    h = [0.0] * k
    for t in range(len(window)) if side == "f" else range(len(window) - 1, -1, -1):
        m = [sum(u[j, i] * h[j] for j in range(k)) for i in range(3 * k)]
        a = w[:, window[t]]
        z = [0.5 + 0.5 * soft(a[i] + m[i]) for i in range(k)]
        r = [0.5 + 0.5 * soft(a[k + i] + m[k + i]) for i in range(k)]
        n = [soft(a[2 * k + i] + r[i] * m[2 * k + i]) for i in range(k)]
        h = [(1 - z[i]) * n[i] + z[i] * h[i] for i in range(k)]
        out[t] = h
    return out


def plain_prediction(network, text):
    """Mean of the label probabilities of all bytes, windows one after the other."""
    raw, total = text.encode(), np.zeros(len(network.languages))
    for at in range(0, len(raw), langid.STEPS):
        # the last window is filled up with zero bytes, which its backward pass reads first
        window = raw[at : at + langid.STEPS].ljust(langid.STEPS, b"\0")
        forward, backward = (plain_states(network.p, s, window) for s in "fb")
        for t in range(min(langid.STEPS, len(raw) - at)):
            logits = network.p["out"].astype(float) @ np.array(forward[t] + backward[t]) + network.p["bias"][:, 0]
            e = np.exp(logits - logits.max())
            total += e / e.sum()
    return total / len(raw)


def test_predictions_equal_the_network_written_out(spark):
    docs = spark.read.parquet(f"{SMALLEST}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    samples = langid.training_windows(docs, "doc_id", "text", "lang", learn).collect()
    network = langid.fit([(r.lang, r.window) for r in samples])
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in langid.predict_languages(docs).collect()}
    short = sorted((i for i, t in texts.items() if t and any(map(str.isalpha, t))), key=lambda i: len(texts[i]))
    for i in short[:12] + short[20:60:8]:
        want = plain_prediction(network, texts[i][:4000]) if len(texts[i]) <= 4000 else None
        if want is not None:
            assert got[i].score == pytest.approx(want.max(), abs=2e-3)
            near = np.sort(want)[-2:]
            assert near[1] - near[0] < 4e-3 or got[i].lang_pred == network.languages[int(want.argmax())]
