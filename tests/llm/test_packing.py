import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spectraloom.llm import packing, wordpieces

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, start string, ids string, sequence_id int"
TEXTS = [
    None, "", " ", "Hello, WORLD!! it's 3.5%", "a<|endoftext|>b", "ΣΑΣ σας", "éclair Å İstanbul", "x y\x1cz\t\x85q",
    "don't 'S ''s _under_score ...", "word " * 30000, "漢字 かな", "ab" * 4000, "..,..", "!!hey", "½² x²", "́a ́",
]


def test_ids_equal_the_tokenizer_on_whole_texts():
    plain = Tokenizer.from_file(PATH)
    made = wordpieces.WordEncoder(PATH, max_words=3)
    for _ in range(2):
        got = made.encode(TEXTS * 2)
        for text, raw in zip(TEXTS * 2, got):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_words_of_letters_ask_the_model_alone(monkeypatch):
    plain, asked = Tokenizer.from_file(PATH), []
    made = wordpieces.WordEncoder(PATH)
    monkeypatch.setattr(made, "_full", lambda text, full=made._full: asked.append(text) or full(text))
    for text in ("les éclairs, L'Été übers schön!! schön. naïve漢字 ªº", "한국어 наука אבג", "ᄀ\u1161ᆨ ΩÅ Å ǆ", "3.5 don't"):
        assert np.frombuffer(made.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    # Jamo compose: the tokenizer alters them
    assert sorted(asked) == sorted([",", "!!", ".", "l'été", "ᄀ\u1161ᆨ", "3.5", "don't"])


@pytest.mark.parametrize("size", [64, 2048])
def test_pieces_cover_every_token_once(spark, size):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(TEXTS * 4)] + [(None, "no id", "x", "y", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, size=size).collect()
    plain = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
    assert set(by_doc) == {r[0] for r in rows}
    for i, text, *_ in rows:
        ids, at = [], 0
        for start, part, total in sorted(by_doc[i]):
            assert start == at
            ids, at = ids + part, at + len(part)
        assert ids == plain.encode(text or "", add_special_tokens=False).ids + [1] and total == len(ids)
    open_windows = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length, fill in sorted(parts):
            assert offset == at
            at += length
        assert at == fill <= size
        open_windows += at < size
    assert open_windows <= 3


def test_level_rule_is_the_smallest_sum_of_squares():
    rnd = np.random.default_rng(0)
    levels, size = packing.SumOfSquares(40), 40
    for _ in range(500):
        length = int(rnd.integers(1, 40))
        counts = levels.counts.copy()

        def after(h):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + length < size:
                c[h + length] += 1
            return int((c * c).sum())

        allowed = [h for h in range(size - length + 1) if h == 0 or counts[h] > 0]
        best = min(after(h) for h in allowed)
        assert levels.level_for(length) == max(h for h in allowed if after(h) == best)
        levels.put((None, 0, length))
        assert Counter(h for h in range(size) for _ in levels.open[h]) == Counter({h: int(n) for h, n in enumerate(levels.counts) if n})


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []
