import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from spectraloom.llm import quality, secrets
from tests.llm.test_linededup import all_earlier
from tests.llm.test_minhash import brute
from tests.llm.test_quality import brute_distances, brute_point, brute_statistics

SMALL = "/root/testdata/sf0.001"


def stages(spark, docs, folder):
    """Every stage's result, written and read again."""
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        yield name, docs


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_stage_equals_its_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = list(stages(spark, docs, tmp_path))
    assert [n for n, _ in made] == ["quality_rules", "line_dedup", "near_dedup", "secret_scans", "packing"]
    before = [tuple(r) for r in docs.collect()]

    # quality: so few rows are judged per language, or all together
    stats = [brute_statistics(r[1]) for r in before]
    fine = [i for i, s in enumerate(stats) if s[0] >= 20 and 100 * s[5] <= 30 * s[0]]
    sizes = Counter(before[i][2] for i in fine)
    groups = {}
    for i in fine:
        groups.setdefault(before[i][2] if sizes[before[i][2]] >= quality.MIN_ROWS else "rest", []).append(i)
    far = {}
    for at in groups.values():
        # too few left for an estimate: held against all points
        judged = at if len(at) >= quality.MIN_ROWS else fine
        found = dict(zip(judged, brute_distances([brute_point(stats[i]) for i in judged])))
        far |= {i: found[i] for i in at}
    assert len(groups) == 2
    kept = [r for i, r in enumerate(before) if i in far and far[i] <= quality.CUTOFF]
    assert rows_of(made[0][1]) == sorted(kept, key=repr)
    assert made[0][1].columns == docs.columns

    # line dedup
    cut = all_earlier([(r[0], r[1]) for r in kept], 20)
    texts = [r[1] if not c else "\n".join(x for p, x in enumerate(r[1].split("\n")) if p not in c) for r, c in zip(kept, cut)]
    left = [
        (*r[:1], t, *r[2:4], len(t) if cut[i] else r[4]) for i, (r, t) in enumerate(zip(kept, texts)) if not cut[i] or t.strip(" \t\n\x0b\x0c\r")
    ]
    assert rows_of(made[1][1]) == sorted(left, key=repr)

    # near-duplicates
    stay = {r[1] for r in brute([(r[0], r[1]) for r in left], 5) if r[4]}
    unique = [r for r in left if r[0] in stay]
    assert rows_of(made[2][1]) == sorted(unique, key=repr)

    # secrets: no pattern is left, texts differ only there
    clean = {r.doc_id: r for r in made[3][1].collect()}
    assert set(clean) == {r[0] for r in unique}
    for r in unique:
        new = clean[r[0]].text
        assert not secrets.base_spans(new)
        pattern = ".*".join(re.escape(p) for p in new.split("[SECRET]"))
        assert re.fullmatch(pattern, r[1], re.S) and (new == r[1]) == (not secrets.base_spans(r[1]) and "[SECRET]" not in new)
        assert clean[r[0]].n_chars == len(new)

    # packing: every token once, in order
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for p in made[4][1].collect():
        assert zlib.crc32(p.ids) == p.ids_crc32
        pieces.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for i, r in clean.items():
        joined = [x for _, ids in sorted(pieces.pop(i)) for x in ids]
        assert joined == tokenizer.encode(r.text, add_special_tokens=False).ids + [1]
    assert not pieces


def test_odd_rows_pass_through(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text, None, None, None), (1, None, "en", "s", None), (2, "", None, "s", 0), (3, text, "en", "s", 9), (3, text, "en", "s", 9), (4, text + " more", "en", None, 1)]
    docs = spark.createDataFrame([(*r, "extra", *["clash"] * 4) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, _gone string, _N_removed string, _found string, n_removed string")
    made = dict(stages(spark, docs, tmp_path / "odd"))
    assert all(df.columns == docs.columns for name, df in made.items() if name != "packing")
    assert sorted(str(r.doc_id) for r in made["secret_scans"].collect()) in (["3", "3", "4", "None"], ["3", "3", "None"])
    empty = dict(stages(spark, docs.limit(0), tmp_path / "empty"))
    assert all(df.count() == 0 for df in empty.values())


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    *_, (_, last) = stages(spark, docs, tmp_path)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.groupBy("doc_id").sum("length").collect().sort() == last.groupBy("doc_id").sum("length").collect().sort()
    assert whole.select(columns).agg({"length": "sum"}).collect() == last.select(columns).agg({"length": "sum"}).collect()
