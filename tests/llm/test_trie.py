import hashlib
import random
import zlib

import numpy as np
import pytest

from spectraloom.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, k1 string, base int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def brute(rows):
    members = {}
    convs = rebuilt(rows)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for key, mine in members.items():
        subtree = [k for k in members if k[: len(key)] == key]
        childless = [k for k in subtree if not any(len(x) == len(k) + 1 and x[:-1] == k for x in subtree)]
        ends = ",".join(map(str, sorted(c for c in mine if convs[c] == key)))
        out.append(
            (
                min(mine), len(key), min(members[key[:-1]]) if key else None, len(mine),
                sum(len(k) == len(key) + 1 for k in subtree), len(childless),
                sum((len(members[k]) - 1) * len(k[-1][1]) for k in subtree if k), sha(ends),
            )
        )
    return sorted(out)


def conversations(seed=3, blocks=3, size=30):
    rnd, rows = random.Random(seed), []
    for b in range(blocks):
        for c in rnd.sample(range(100 * b - 40, 100 * b + 60), size) + [100 * b] * (b != 1):
            for t in range(rnd.choice([1, 2, 4, 4, 9])):
                rows.append((c, t, ("user", "assistant")[t % 2], rnd.choice(["hi", "ß\U0001f600", "", "long " * 9]) if t < 3 else f"{t} {c % 3}"))
    rows += [(4001, None, None, "null first"), (4001, -3, None, "null first"), (4001, 7, "user", None), (4000, 0, "a", "b:c"), (4000, 1, "a:", "bc")]
    rows += [(None, 0, "user", "hi"), (None, None, None, None), (-4007, None, None, None), (5001, 2, "u", "x"), (5001, 2, "u", "x"), (5001, 2, "u", "y")]
    rows += [(6000 + i, t, "user", "same" if t < 7 else f"{i % 4}") for i in range(12) for t in range(8)]
    return [(*r, "x", "y", 1) for r in dict.fromkeys(rows)] + [(5001, 2, "u", "x", "x", "y", 1)]


def result(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(df.columns) == sorted(columns)
    return sorted(tuple(r) for r in df.select(columns).collect())


@pytest.mark.parametrize("max_shard, together", [(None, None), (20, 7), (1, 1)])
def test_equals_brute_force(spark, max_shard, together, monkeypatch):
    if max_shard:
        monkeypatch.setattr(trie, "CHUNK_BITS", 1)
    rows = conversations()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = result(trie.prefix_trie(df, max_shard, together))
    assert got == brute(rows)
    assert max(r[1] for r in got) == 9 and got[-1][4] == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    # bases are absent: all that have no more turns than they would take are turnless
    rows = [(c, 0, "user", "only", "x", "y", 1) for c in range(101, 140)]
    got = result(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows) and len(got) == 2 and got[0][4] == 1
    only = [(c, 0, "user", "only", "x", "y", 1) for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6]
    assert result(trie.prefix_trie(spark.createDataFrame(only, SCHEMA))) == brute(only)


def test_empty_table(spark):
    assert result(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert result(trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "x", "y", 1)], SCHEMA))) == []


def test_perfect_hash_is_minimal_and_verified():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        a, b = rnd.integers(0, 2**63, (2, n), dtype=np.uint64)
        table = trie.NodeTable(a, b)
        assert np.array_equal(np.sort(table.slot), np.arange(n))
        assert np.array_equal(table.find(a, b), table.slot)
        assert (table.find(a + np.uint64(1), b) == -1).all()
    with pytest.raises(ValueError):
        trie.NodeTable(np.array([7, 7], np.uint64), np.array([9, 9], np.uint64))


def test_sums_go_up_a_deep_chain():
    n = 3000
    keys = np.arange(1, n + 1, dtype=np.uint64)
    up = np.concatenate([[0], keys[:-1]]).astype(np.uint64)
    order = np.random.default_rng(2).permutation(n)
    zeros = np.zeros(n, np.uint64)
    parent, children, leaves, saved = trie.accumulate(keys[order], zeros, up[order], zeros, order + 1, np.full(n, 2), np.ones(n, np.int64))
    assert saved.tolist() == [n - d for d in order] and (leaves == 1).all()
    assert children.sum() == n - 1 and (parent >= 0).sum() == n - 1
