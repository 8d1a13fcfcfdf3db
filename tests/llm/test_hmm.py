import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spectraloom.llm import hmm, words

SCHEMA = "doc_id bigint, text string, row string, symbols string, key int, learn string"


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def documents():
    rnd = np.random.default_rng(2)
    a, b = [f"a{i}" for i in range(40)], [f"B{i}é" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(a if i % 2 else b, rnd.integers(1, 120)))) for i in range(300)]
    # more words than symbols: the rarest are scored by their class
    rows += [(2000 + k, " ".join(f"w{j % 90_000}" for j in range(20_000 * k, 20_000 * k + 22_000))) for k in range(5)]
    rows += [(1000, None), (1001, ""), (1002, "never seen words here"), (None, "a1 a2 onlyhere"), rows[5], (1003, "a1 " * 5000)]
    return [(i, t, "x", "y", 1, "z") for i, t in rows]


def test_counts_and_unigram_scores_equal_brute_force(spark):
    rows = documents()
    got = hmm.score_documents(spark.createDataFrame(rows, SCHEMA), rounds=1).collect()
    train = Counter()
    for i, t, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    want = []
    for i, t, *_ in rows:
        x = tokens(t)
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in x)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        want.append((i is None, i or 0, held, len(x), sum(train[w] > 0 for w in x), n, round(base, 6)))
    have = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(have) == sorted(want)
    held = [r for r in got if r.held_out]
    # two vocabularies never mix in a text: states pay off
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_are_the_same_in_either_case_to_their_last_letter(spark):
    texts = ["END the", "end THE", "eND tHE mAZE", "Z z", "enD maze"]
    rows = [(i, texts[i % len(texts)], "x", "y", 1, "z") for i in range(40)]
    got = hmm.score_documents(spark.createDataFrame(rows, SCHEMA), rounds=1).collect()
    train = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    for r in got:
        x = tokens(texts[r.doc_id % len(texts)])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(train[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in x), abs=1e-9)


def random_model(states=3):
    rnd = np.random.default_rng(0)
    emit = np.zeros((hmm.SYMBOLS, states))
    emit[:6] = rnd.dirichlet(np.ones(6), states).T
    return hmm.Model(*rnd.dirichlet(np.ones(states), 2), rnd.dirichlet(np.ones(states), states), emit)


def path_sums(model, x, first=True):
    """Probability and expected counts of a sequence, over all paths of states."""
    s = len(model.start)
    total, gamma, moves = 0.0, np.zeros((len(x), s)), np.zeros((s, s))
    for path in itertools.product(range(s), repeat=len(x)):
        p = float((model.start if first else model.go)[path[0]]) * float(model.emit[x[0], path[0]])
        for r, t, w in zip(path, path[1:], x[1:]):
            p *= float(model.moves[r, t]) * float(model.emit[w, t])
        total += p
        for place, r in enumerate(path):
            gamma[place, r] += p
        for r, t in zip(path, path[1:]):
            moves[r, t] += p
    return total, gamma / total, moves / total


def test_forward_is_the_sum_over_all_paths():
    model = random_model()
    sequences = [np.array(x, dtype="<u2") for x in ([0], [1, 2, 3, 0], [5, 5, 0], [4, 3, 2, 1, 5, 0])]
    got = hmm.forward(model, sequences)
    for x, value in zip(sequences, got):
        assert value == pytest.approx(math.log(path_sums(model, x)[0]), rel=1e-5)


def test_expected_counts_of_windows_of_any_length():
    model = random_model()
    texts = [([1, 2, 3, 0], True), ([5, 0, 4], False), ([4, 4, 1], True), ([2], False)]
    windows = np.zeros((4, 4), np.uint16)
    for i, (x, _) in enumerate(texts):
        windows[i, : len(x)] = x
    sums = hmm.Sums(3)
    likely, gamma = hmm.expected_counts(model, windows, np.array([4, 3, 3, 1]), np.array([f for _, f in texts]), sums)
    each = [path_sums(model, x, f) for x, f in texts]
    assert likely == pytest.approx(sum(math.log(p) for p, _, _ in each), rel=1e-5)
    assert np.allclose(sums.moves, sum(m for _, _, m in each), atol=1e-5)
    assert np.allclose(sums.start, each[0][1][0] + each[2][1][0], atol=1e-5) and np.allclose(sums.go, each[1][1][0] + each[3][1][0], atol=1e-5)
    emit = np.zeros((6, 3))
    for (x, _), (_, g, _), i in zip(texts, each, range(4)):
        np.add.at(emit, x, g)
        assert np.allclose(gamma[: len(x), i], g, atol=1e-5) and not gamma[len(x) :, i].any()
    assert np.allclose(sums.emit[:6], emit, atol=1e-5)


def test_rounds_never_lower_the_likelihood():
    rnd = np.random.default_rng(4)
    lengths = -np.sort(-rnd.integers(1, 17, 50))
    windows = rnd.integers(0, 6, (50, 16)).astype(np.uint16)
    model, before = random_model(), -np.inf
    for _ in range(6):
        sums = hmm.Sums(3)
        now, _ = hmm.expected_counts(model, windows, lengths, np.ones(50, bool), sums)
        assert sums.emit.sum() == pytest.approx(lengths.sum(), rel=1e-4) and sums.moves.sum() == pytest.approx((lengths - 1).sum(), rel=1e-4)
        assert now >= before - 1e-2
        before = now
        model = hmm.Model(sums.start / sums.start.sum(), model.go, sums.moves / sums.moves.sum(1, keepdims=True), sums.emit / sums.emit.sum(0))


def test_windows_cover_every_token_once(monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 600)
    top = hmm.K
    texts = [(i, (np.arange(n) % 7 + np.where(np.arange(n) % 5 == i % 5, top + 1, 0)).astype("<u2")) for i, n in enumerate((1, 3, 255, 256, 700, 5000))]
    texts = [(i, x, (np.flatnonzero(x > top) + 10_000 * i).astype("<u8")) for i, x in texts]

    def tokens_of(part):
        out, keys, firsts = [], [], 0
        numbers, symbols, rare_keys = np.array([i for i, _, _ in texts]), [x for _, x, _ in texts], np.concatenate([k for _, _, k in texts])
        assert all(k is None for *_, k in hmm.blocks_of(numbers, symbols, None, part))
        for windows, lengths, first, rare in hmm.blocks_of(numbers, symbols, rare_keys, part):
            valid = np.arange(windows.shape[1]) < lengths[:, None]
            assert windows.size <= max(600, windows.shape[1]) and (np.diff(lengths) <= 0).all() and ((windows > top) & valid).sum() == len(rare)
            out += windows[valid].tolist()
            keys += rare.tolist()
            firsts += first.sum()
        return Counter(out), Counter(keys), firsts

    want = Counter(np.concatenate([x for _, x, _ in texts]).tolist()), Counter(np.concatenate([k for _, _, k in texts]).tolist()), 6
    assert tokens_of(None) == want
    parts = [tokens_of(p) for p in range(hmm.SLICES)]
    assert tuple(sum((p[k] for p in parts), Counter() if k < 2 else 0) for k in range(3)) == want
    assert max(p[0].total() for p in parts) < want[0].total() / 2


def test_scores_equal_the_model_written_out(spark, monkeypatch):
    """Every score again, word by word in Python, from the fitted tables; the words of a state add up to 1."""
    rnd = np.random.default_rng(7)
    a, b = [f"a{i}" for i in range(300)], [f"b{i}x" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(a if i % 2 else b, rnd.integers(1, 60), p=None))) for i in range(150)]
    rows += [(900, "a1 zzz b2x unseen"), (901, None), (902, "A5 " * 700), (903, "rare"), (904, "rare"), (905, "rare")]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(hmm, "HELD_TAIL", 50)
    # all but the most frequent words are rare
    fitted = hmm.Fitted(hmm.prepared(docs), states=3, rounds=2, most=40, near=150)
    # some rare words are known to the tasks, the others come by the join
    assert 0 < len(fitted.tails.near[0]) <= 150 and fitted.tails.far.count() > 0
    got = {r.doc_id: r for r in hmm.score(fitted).collect()}
    assert 0 < len(fitted.vocabulary.keys) <= 40
    table = {r.key: (r.c, np.array([(r.tilt >> 5 * k) % 32 - 16 for k in range(3)])) for r in fitted.tails.table.collect()}
    assert len(table) > 100
    m, mass = fitted.model, fitted.tails.mass
    assert len({tuple(t) for _, t in table.values()}) > 10
    numerator = {k: (c + 1) * np.exp2(t / hmm.STEP) for k, (c, t) in table.items()}
    added = np.ones((256, 3))
    for k, x in numerator.items():
        added[k & 255] += x
    assert np.allclose(added, mass)
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens(t))
    assert sum(c for c, _ in table.values()) + fitted.vocabulary.counts[: 1 + hmm.K].sum() == sum(train.values())
    for r in fitted.encoded.collect():
        x, keys, at, likely = np.frombuffer(r.symbols, "<u2"), np.frombuffer(r.tail, "<i8"), 0, 0.0
        state = m.start.astype(float)
        for t, symbol in enumerate(x.tolist()):
            e = m.emit[symbol].astype(float)
            if symbol > hmm.K:
                key = int(keys[at])
                e, at = e * numerator.get(key, np.ones(3)) / mass[key & 255], at + 1
            state = (state @ m.moves.astype(float) if t else state) * e
            likely += math.log10(state.sum())
            state = state / state.sum()
        assert got[r.doc_id].score == pytest.approx(likely, rel=1e-4, abs=1e-3)


def test_counts_on_the_way_keep_16_bits():
    x = np.array([[0.0, 1.0, 3.0, 1e-7, 123456.789, 2.0**-130, 65535.0]])
    got = hmm.shortened(x)
    assert (got[0, [0, 1, 2, 6]] == x[0, [0, 1, 2, 6]]).all() and np.allclose(got[0, :5], x[0, :5], rtol=2**-16)


class Counted(np.ndarray):
    """Counts its lookups."""

    lookups = 0

    def take(self, *args, **kwargs):
        Counted.lookups += 1
        return np.asarray(self).take(*args, **kwargs)

    def __getitem__(self, item):
        Counted.lookups += 1
        return np.asarray(self)[item]


def test_forward_looks_emissions_up_in_blocks_of_steps(monkeypatch):
    rnd = np.random.default_rng(5)
    model, plain = random_model(), random_model()
    model.emit = model.emit.view(Counted)
    sequences = [rnd.integers(0, 6, n).astype("<u2") for n in (1, 400, 7, 7, 90, 2)]
    rare = [np.where(x == 5, np.arange(len(x)) % 3, -1) for x in sequences]
    factors = rnd.uniform(0.5, 2, (3, 3)).astype(np.float32)
    monkeypatch.setattr(Counted, "lookups", 0)
    got = hmm.forward(model, sequences, rare, factors)
    assert 0 < Counted.lookups < 10
    for x, odd, value in zip(sequences, rare, got):
        likely, state = 0.0, plain.start.astype(float)
        for t, (symbol, f) in enumerate(zip(x, odd)):
            e = plain.emit[symbol] * (factors[f] if f >= 0 else 1.0)
            state = (state @ plain.moves if t else state) * e
            likely += math.log(state.sum())
            state = state / state.sum()
        assert value == pytest.approx(likely, rel=1e-5)
    monkeypatch.setattr(hmm, "STEP_TOKENS", 5)
    assert np.allclose(hmm.forward(plain, sequences, rare, factors), got, rtol=1e-12)


def test_hashes_are_found_through_their_first_bits():
    rnd = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 3000):
        # half of them share their first bits
        held = np.unique(np.concatenate([rnd.integers(0, 2**64, n, dtype=np.uint64), rnd.integers(0, 2**20, n, dtype=np.uint64)]))
        asked = np.concatenate([held, held + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        at, there = words.Places(held).find(asked)
        assert (there == np.isin(asked, held)).all() and (held[at[there]] == asked[there]).all()


def test_a_word_has_one_hash_wherever_it_stands(monkeypatch):
    texts = ["one Two\x0bthree", "two", "", None, "x" * 300 + " two", " two\n" * 40, "é\x1cz two"]

    def hashes():
        h, first, last = words.hash_words(*words.text_bytes(pa.array(texts)), last_byte=True)
        return h.tolist(), first.tolist(), last.tolist()

    h, first, last = hashes()
    assert first == [0, 3, 4, 4, 4, 6, 46, 48] and len(set(h)) == 5
    assert {h[i] for i in (1, 3, 5, 47, *range(6, 46))} == {h[1]} and last[:2] == [ord("e"), ord("o")]
    for chunk in (1, 3, 17, 5000):
        monkeypatch.setattr(words, "CHUNK", chunk)
        assert hashes() == (h, first, last)


def test_distinct_rare_words_per_text():
    rnd = np.random.default_rng(8)
    keys = [rnd.integers(0, 9, n).astype("<u8") << np.uint64(60) for n in (0, 5, 0, 30, 1, 0)]
    got, text, first, which = hmm.distinct_keys([k.tobytes() for k in keys])
    for i, k in enumerate(keys):
        assert (got[first[i] : first[i + 1]] == np.unique(k)).all() and (text[first[i] : first[i + 1]] == i).all()
    assert (got[which] == np.concatenate(keys)).all()


def test_empty_table(spark):
    assert hmm.score_documents(spark.createDataFrame([], SCHEMA), rounds=1).collect() == []
