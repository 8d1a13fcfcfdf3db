import random
import re

import numpy as np
import pytest

from spectraloom.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, _w string, distance int"


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


def brute_point(s):
    n, chars, symbols, lines, dup, rep = s
    return [
        np.log((chars + 500) / (n + 100)), np.sqrt(symbols / (chars + 200)), np.sqrt(dup / (lines + 5)), np.sqrt(rep / (n + 100))
    ]


def brute_distances(points):
    """The two-start estimate over one group, in numpy."""
    x, floors, best = np.array(points), np.array(quality.FLOORS), None
    med = []
    for d in range(x.shape[1]):
        b = np.floor(x[:, d] * 1000)
        values, counts = np.unique(b, return_counts=True)
        med.append((values[np.cumsum(counts) >= np.ceil(len(b) * 0.5)][0] + 0.5) / 1000)
    for name, mean, cov in (
        ("medians", np.array(med), np.diag(floors**2)),
        ("moments", x.mean(0), np.cov(x.T, bias=True) + np.diag(floors**2)),
    ):
        for _ in range(quality.STEPS):
            z = np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T)
            b = np.floor(np.log1p((z**2).sum(0)) * 50)
            values, counts = np.unique(b, return_counts=True)
            near = x[b <= values[np.cumsum(counts) >= np.ceil(len(b) * quality.SHARE)][0]]
            mean = near.mean(0)
            cov = np.cov(near.T, bias=True) * quality.consistency(quality.SHARE) + np.diag(floors**2)
        key = (np.linalg.slogdet(cov)[1] / 2, name)
        if best is None or key < best[0]:
            best = (key, (np.linalg.solve(np.linalg.cholesky(cov), (x - mean).T) ** 2).sum(0))
    return best[1]


def documents():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 9)))
    out = [None, "", " \t\n\x0b\x0c\r", "one", "a b c d e f g h " * 40, "x\n \nx\n x\nx", "\x1c\x85 \U0001f600#*|", "w " * 3000]
    for k in range(240):
        text = " ".join(word() for _ in range(rnd.randint(15, 300)))
        if k % 10 == 0:
            text = text.replace(" ", "*** ")
        if k % 17 == 0:
            text = "\n".join([text[:60]] * 4 + [text])
        out.append(text.replace(" ", rnd.choice([" ", "\n", "\t"])) if k % 3 == 0 else text)
    rows = [(i, t, "en", None if i % 2 else "s", 0, "x", "y", 1) for i, t in enumerate(out)]
    return rows + [rows[20], (None, rows[30][1], None, None, None, None, None, None)]


def test_statistics_and_verdicts_equal_brute_force(spark):
    rows = documents()
    got = quality.judge(spark.createDataFrame(rows, SCHEMA), min_rows=60).collect()
    assert len(got) == len(rows)
    groups, stats = {}, {}
    for i, r in enumerate(rows):
        s = stats[i] = brute_statistics(r[1])
        failed = s[0] < 20 or 100 * s[5] > 30 * s[0]
        if not failed:
            groups.setdefault((r[2], r[3]) if r[2] else "few", []).append((i, brute_point(s)))
    verdict = {}
    everything = [x for points in groups.values() for x in points]
    for key, points in groups.items():
        # the few are judged with all others
        judged = points if key != "few" else everything
        for (i, _), d in zip(judged, brute_distances([p for _, p in judged])):
            if (i, _) in points:
                verdict[i] = d
    want = sorted(
        (r[0] is not None, r[0] or 0, *stats[i], i in verdict and (verdict[i] is None or verdict[i] <= quality.CUTOFF)) for i, r in enumerate(rows)
    )
    have = sorted(
        (g.doc_id is not None, g.doc_id or 0, g.n_words, g.word_chars, g.n_symbols, g.n_lines, g.n_dup_lines, g.n_repeat_words, g.kept)
        for g in got
    )
    assert have == want
    assert 0 < sum(not g.kept and not g.base_failed for g in got) < 60
    for g in got:
        if g.distance is not None and g.doc_id is not None:
            assert g.distance == pytest.approx(verdict[g.doc_id], rel=1e-6)


def test_keep_good_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    kept = quality.keep_good(docs, min_rows=60)
    assert kept.columns == docs.columns
    assert kept.count() == quality.judge(docs, min_rows=60).filter("kept").count()


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.judge(docs).collect() == [] and quality.keep_good(docs).collect() == []


def test_few_leftovers_are_held_against_all_points(spark):
    rows = documents()
    odd = " ".join(f"#*$%&|<>{i}" for i in range(90))
    plain = " ".join(f"word{i}" for i in range(90))
    rows += [(900, odd, "rare", "s", 0, "x", "y", 1), (901, plain, "rare", "s", 0, "x", "y", 1)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA), min_rows=60).collect()}
    fine = [(r[0], s) for r in rows for s in [brute_statistics(r[1])] if not (s[0] < 20 or 100 * s[5] > 30 * s[0])]
    want = dict(zip([i for i, _ in fine], brute_distances([brute_point(s) for _, s in fine])))
    for i in (900, 901):
        assert (got[i].distance is None) == (i not in want)
        assert got[i].distance is None or got[i].distance == pytest.approx(want[i], rel=1e-6)
    assert got[900].distance > quality.CUTOFF and not got[900].kept and got[901].distance is not None
    few = quality.judge(spark.createDataFrame(rows[:60], SCHEMA), min_rows=100).collect()
    assert all(r.distance is None for r in few)
