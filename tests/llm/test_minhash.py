import random
import re

import numpy as np
import pyarrow as pa

from spectraloom.llm import minhash, words
from spectraloom.llm.graph import components

SCHEMA = "doc_id bigint, text string, kept string, n_shingles string, component_id string, c int, x int, node int"


def brute_set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width):
    sets = [(r[0], brute_set(r[1], width)) for r in rows]
    parent = {i: i for i in range(len(sets))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, s) in enumerate(sets):
        for j, (b, t) in enumerate(sets[:i]):
            if a is not None and b is not None and (a == b or s and t and 100 * len(s & t) >= 80 * len(s | t)):
                parent[root(i)] = root(j)
    least = {}
    for i, (a, _) in enumerate(sets):
        if a is not None:
            least[root(i)] = min(least.get(root(i), a), a)
    return sorted(
        (a is None, a or 0, len(s), None if a is None else least[root(i)], a is None or least[root(i)] == a)
        for i, (a, s) in enumerate(sets)
    )


def documents():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    texts = [None, "", " \n", "One", "one", "One two", "one  TWO", "a b a b a b", "É é"]
    for size in (12, 30, 80, 400):
        base = [word() for _ in range(size)]
        for k in range(18):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, size * k // 150))):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if k % 2 else "\n".join(copy).upper().replace("É", "é"))
    texts += [" ".join(word() for _ in range(rnd.randint(3, 60))) for _ in range(40)] + ["x " * 9000, "longword" * 9000]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(None, texts[20]), (None, None), (60, texts[60]), (30, texts[10]), (33, texts[11])]
    rnd.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = documents()
    frame = spark.createDataFrame([(*r, "a", "b", "c", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    for width in (2, 5):
        got = minhash.near_duplicates(frame, width=width).collect()
        have = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in got)
        assert have == brute(rows, width)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_chain_through_a_bucket_is_not_lost(spark):
    """Members that miss the centre but link with one another are found."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[6 * i : 6 * i + 100])) for i in range(16)]
    rows += [(100 - i, " ".join(base[6 * i : 6 * i + 100] + ["tail"])) for i in range(16)]
    frame = spark.createDataFrame([(*r, "a", "b", "c", 1, 2, 3) for r in rows], SCHEMA)
    got = minhash.near_duplicates(frame, width=2).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 2)


def test_signature_agreement_estimates_similarity():
    rnd = np.random.default_rng(1)
    make = minhash.Circulant(240)
    a = rnd.integers(0, 2**63, 1000).astype(np.uint64)
    for shared in (200, 500, 900):
        b = np.concatenate([a[:shared], rnd.integers(0, 2**63, 1000 - shared).astype(np.uint64)])
        seen = (make.signature(a) == make.signature(b)).mean()
        assert abs(seen - shared / (2000 - shared)) < 0.12


def test_words_match_a_plain_split():
    texts = ["", "A b\tA\x0b\x1c", None, "é É", "x" * 3_000_000, "b a", " " * 10, "long " * 700_000]
    raw, offsets = words.text_bytes(pa.array(texts).slice(0))
    hashes, first = words.hash_words(raw, offsets)
    seen = {}
    for i, text in enumerate(texts):
        plain = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        got = hashes[first[i] : first[i + 1]].tolist()
        assert len(got) == len(plain)
        for w, h in zip(plain, got):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    part = pa.array(texts).slice(3, 3)
    assert words.hash_words(*words.text_bytes(part))[0].tolist() == hashes[first[3] : first[6]].tolist()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (301, 302), (302, 301)]
    got = dict(components(spark.createDataFrame(links, "u bigint, v bigint")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50))
    assert got[302] == 301 and 300 not in got


def test_blocks_of_a_star_give_every_link_across_components():
    rnd = np.random.default_rng(3)
    c = np.sort(rnd.integers(0, 2**62, 60))
    sets = []
    for k in range(40):
        gone = rnd.choice(60, rnd.integers(0, 16), replace=False)
        base = sets[k - 1] if k % 3 == 2 else np.delete(c, gone)
        sets.append(np.unique(np.concatenate([base, rnd.integers(0, 2**62, rnd.integers(0, 5))])))
    rows = [
        {"x": i, "component": i, "r": len(np.setdiff1d(c, s)), "a": len(np.setdiff1d(s, c)), "d": np.setxor1d(c, s).tolist()}
        for i, s in enumerate(sets)
    ]
    similar = lambda s, t: 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))
    missed = [r for r in rows if not similar(c, sets[r["x"]])]
    want = {(x["x"], y["x"]) for y in missed for x in rows if x is not y and similar(sets[x["x"]], sets[y["x"]])}
    assert set(minhash._links_of_blocks(60, missed, rows, 80)) == want and len(want) > 3


def test_four_shingles_within_five_link(spark):
    words = [f"v{i}" for i in range(40)]
    rows = []
    for width in (2, 5):
        for n in (2, 3, 4, 5):
            at = 100 * width + 10 * n
            rows += [(at, " ".join([f"{width}{n}", *words[: n + width - 2]])), (at + 1, " ".join([f"{width}{n}", *words[: n + width - 1]]))]
    frame = spark.createDataFrame([(*r, "a", "b", "c", 1, 2, 3) for r in rows], SCHEMA)
    for width in (2, 5):
        got = minhash.near_duplicates(frame, width=width).collect()
        assert sorted((False, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, width)
        at = 100 * width + 40
        assert [(r.n_shingles, r.component_id) for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id in (at, at + 1)] == [(4, at), (5, at)]
