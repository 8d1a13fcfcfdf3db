import random

from pyspark.sql import functions as F

from spectraloom.llm import linededup as ld

SCHEMA = "doc_id bigint, text string, id string, version string, cuts string, h int, lang string"


def documents():
    rnd = random.Random(9)
    line = lambda n: " ".join("".join(rnd.choice("abcd") for _ in range(4)) for _ in range(n))
    passage = [line(9) for _ in range(5)]
    common, boiler = line(30), line(3)
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, boiler)]
    for k in range(5, 45):
        body = [line(rnd.randint(1, 12)) for _ in range(rnd.randint(1, 12))]
        if k % 3 == 0:
            at = rnd.randint(0, len(body))
            body[at:at] = [*passage[:2], "", *passage[2:]] if k % 2 else passage
        if k % 4 == 0:
            body.insert(rnd.randint(0, len(body)), common)
        if k % 5 == 0:
            body += [boiler] * 3
        rows.append((k, "\n".join(body)))
    rows += [(100 + k, rows[k][1]) for k in range(4, 30, 4)]
    rows += [(200 + k, "\n".join([*rows[20][1].split("\n"), line(8)])) for k in range(15)]
    rows += [(None, rows[10][1]), (100, "other version " + rows[12][1]), rows[8], (300, "\n".join(["again and again " * 8] * 400)), (301, "\n".join(["again and again " * 8] * 500))]
    rnd.shuffle(rows)
    return rows


def test_first_holder_keeps_its_text(spark):
    rows = documents()
    frame = spark.createDataFrame([(k, t, "a", "b", "c", 1, "x") for k, t in rows], SCHEMA)
    first = min(k for k, t in rows if k is not None and t)
    assert [r.n_removed for r in ld.cut_shared_blocks(frame).filter(f"doc_id = {first}").collect()] == [0]
    assert ld.cut_shared_blocks(frame.limit(0)).collect() == []


def test_patience_matches_unique_lines_in_order():
    a, b = list("xabcyabz"), list("qabcwz")
    pairs = ld.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
    assert {(3, 3), (7, 5)} <= set(pairs)
    assert ld.patience([], list("a")) == [] and len(ld.patience(list("aaaa"), list("aaaa"))) == 4


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_ranges_without_unique_lines_get_a_longest_subsequence(monkeypatch):
    rnd = random.Random(6)
    for n in (0, 1, 5, 30, 80):
        for _ in range(20):
            a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, n))] for _ in "ab")
            pairs = ld.common_subsequence(a, b)
            assert len(pairs) == lcs_length(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))
    monkeypatch.setattr(ld, "MOST_BITS", 40)
    for _ in range(50):
        a, b = ([rnd.choice("abcd") for _ in range(20)] for _ in "ab")
        pairs = ld.common_subsequence(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and bool(pairs) == bool(set(a) & set(b))
        assert all(p < r and q < s for (p, q), (r, s) in zip(pairs, pairs[1:]))


def test_alignment_again_finds_all_that_is_shared():
    rnd = random.Random(7)
    for _ in range(300):
        a, b = ([rnd.randint(0, 12) for _ in range(rnd.randint(0, 25))] for _ in "ab")
        assert ld.repeated_alignment(a, b) == [i for i, x in enumerate(a) if x in b]


def test_cuts_come_from_the_alignment(spark, monkeypatch):
    monkeypatch.setattr(ld, "patience", lambda a, b: [])
    assert ld.repeated_alignment([1, 2], [1, 2]) == [] and ld.aligned_blocks([(0, 5, 1, 3)], [(0, 5)]) == []


def test_rows_of_a_collection_grow_with_its_passages(spark):
    """A document that collects one passage each of n others sends n links, not n times n lines."""
    sent = {}
    for n in (40, 80):
        passage = lambda k: "\n".join(f"passage {k} line {i} with some eight words here" for i in range(4))
        rows = [(k, passage(k)) for k in range(n)] + [(n, "\n".join(passage(k) + f"\nown {k}" for k in range(n)))]
        frame = spark.createDataFrame(rows, "id bigint, text string")
        lines = F.collect_set(F.struct("ordinal", "h", "words", "place")).alias("lines")
        kept = ld._lines_of(ld._entries(frame, "id", "text")).groupBy("id", "version").agg(lines)
        sent[n] = ld._links(ld._seeds_of(kept, 20)).count()
        texts = {r.id: r.text for r in ld.cut_shared_blocks(frame, doc_id="id").collect()}
        assert texts[n] == "\n".join(f"own {k}" for k in range(n))
    assert sent[80] == 2 * sent[40]


def all_earlier(rows, min_words):
    """Places cut from each row when every run of lines is compared with every earlier document."""
    docs = []
    for key, text in rows:
        docs.append((key, [(p, x.strip(" ")) for p, x in enumerate((text or "").split("\n")) if x.strip(" ")]))
    cut = []
    for key, lines in docs:
        gone = set()
        for e, other in docs:
            if key is None or e is None or e >= key:
                continue
            at = {}
            for j, (_, x) in enumerate(other):
                at.setdefault(x, []).append(j)
            before = {}
            for i, (_, x) in enumerate(lines):
                now = {}
                for j in at.get(x, ()):
                    start, n = before.get(j - 1, (i, 0))
                    now[j] = (start, n + x.count(" ") + 1)
                    if now[j][1] >= min_words:
                        gone |= set(range(lines[start][0], lines[i][0] + 1))
                before = now
        cut.append(gone)
    return cut


def assert_cuts(spark, rows, min_words):
    frame = spark.createDataFrame([(k, t, "a", "b", "c", 1, str(i)) for i, (k, t) in enumerate(rows)], SCHEMA).repartition(4)
    got = {int(r.lang): r for r in ld.cut_shared_blocks(frame, min_words=min_words).collect()}
    for i, cut in enumerate(all_earlier(rows, min_words)):
        text = rows[i][1]
        want = text if not cut else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in cut)
        assert (got[i].text, got[i].n_removed) == (want, len(cut))
    return got


def test_no_block_of_any_earlier_document_is_left(spark):
    rows = documents()
    for min_words in (20, 5):
        assert_cuts(spark, rows, min_words)


def test_blocks_of_hot_lines_with_different_first_holders(spark):
    line = lambda name, n: " ".join([name] * n)
    p, q, r = line("p", 12), line("q", 12), line("r", 3)
    rows = [(1, p), (2, q), (3, r)]
    rows += [(10 + k, f"own {k}\n{x}") for k in range(12) for x in [(p, q, r)[k % 3]]] * 4
    rows += [(100 + k, f"start {k}\n{p}\n \n{q}\n{r}\nend {k}") for k in range(10)]
    # a line too short to start a seed, after one that the first holder goes on from otherwise
    s, t = line("s", 19), line("t", 1)
    rows += [(200, f"{s}\n{t}\nelse"), (201, f"{s}\n{t}\n{r}\nx"), (202, f"{s}\n{t}\n{r}\ny")]
    # the blank line between two long lines lies in a block with 302 only
    u, v = line("u", 25), line("v", 25)
    rows += [(300, u), (301, v), (302, f"{u}\n{v}"), (303, f"z\n{u}\n\n{v}")]
    got = assert_cuts(spark, rows, 20)
    assert {r.doc_id: r.text for r in got.values()}[105] == "start 5\nend 5"


def test_moved_and_repeated_blocks_are_cut(spark):
    rng = random.Random(5)
    p, q, x = (["".join(rng.choice("abc") for _ in range(6)) + " w" * 11 + f" {n}{i}" for i in range(3)] for n in "pqx")
    rows = [(1, "\n".join(p + ["one"] + q)), (2, "\n".join(q + ["two"] + p)), (3, "\n".join(p + q + p + ["three"] + q[:2]))]
    # many single lines in order outnumber the block that moved; lines that repeat on both sides
    rows += [(4, "\n".join(x[:2] + [f"s {i}\nfour {i}" for i in range(9)])), (5, "\n".join([f"s {i}\nfive {i}" for i in range(9)] + x[:2]))]
    rows += [(6, "\n".join(["k a", *x, "k b", *x, "k c"])), (7, "\n".join(["m", *x[1:], *x[:2], "n", *x[1:]]))]
    got = {r.doc_id: r.text for r in assert_cuts(spark, rows, 20).values()}
    assert got[2] == "two" and got[3] == "three" and got[5].split("\n") == [y for i in range(9) for y in (f"s {i}", f"five {i}")]
