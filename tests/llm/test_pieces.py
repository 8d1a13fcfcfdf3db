import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, ids string, key int, decoded string, log_prob string"
TEXTS = [None, "", " ", "  a\n b\tx  ", "▁x▁ ▁", "é\U0001f600 漢字", "hello world", "\n\n \n", "a" * 3000, "\x00\x7f", "word " * 20000]


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab▁é"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6))
def test_round_trip(texts):
    made = pieces.lattice(PATH, 1.0, 0)
    ids, _ = made.sample(texts, np.arange(len(texts)))
    assert [made.decode(x.tolist()) for x in ids] == texts


def test_places_without_a_piece_are_not_looked_up(lattice, monkeypatch):
    text, sizes, search = "zqxjkvwyzqxjkvwp" * 200, [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: sizes.append(np.size(v)) or search(a, v, *rest))
    arcs = len(lattice.build([text])[3])
    assert arcs <= sum(sizes) <= 2 * arcs


def all_cuts(lattice, chars):
    """Every segmentation of a word with its weight, by recursion."""
    known = {p: lattice.weight[i] for p, i in lattice.pieces}
    if not chars:
        return {(): 0.0}
    out = {}
    for n in range(1, min(len(chars), lattice.longest) + 1):
        if chars[:n] in known:
            for rest, w in all_cuts(lattice, chars[n:]).items():
                out[(chars[:n], *rest)] = w + known[chars[:n]]
    return out


def test_draws_follow_the_exact_distribution():
    flat = pieces.Lattice(PATH, sharpness=0.2, seed=9)
    cuts = all_cuts(flat, "▁other")
    total = math.log(sum(map(math.exp, cuts.values())))
    n = 20000
    ids, logp = flat.sample(["other"] * n, np.arange(n))
    text = {i: p for p, i in flat.pieces}
    seen = Counter(tuple(text[i] for i in x.tolist()) for x in ids)
    assert set(seen) <= set(cuts)
    for cut, w in cuts.items():
        share = math.exp(w - total)
        assert abs(seen[cut] / n - share) < 5 * math.sqrt(share / n) + 1e-3
    for x, p in zip(ids[:50], logp[:50]):
        assert p == pytest.approx(cuts[tuple(text[i] for i in x.tolist())] - total, abs=1e-6)


def test_rows_keep_their_segmentation(spark):
    rnd = random.Random(0)
    texts = TEXTS + [" ".join(rnd.choice(["Baum", "the", "straße", "x.y"]) for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "a", 1, "b", "c") for i, t in enumerate(texts)] + [(None, "no key", "a", 1, "b", "c")] * 2
    one = spark.createDataFrame(rows, SCHEMA)
    first = pieces.decode_pieces(pieces.encode_sampled(one.coalesce(1), PATH, sharpness=0.3), PATH).collect()
    other = pieces.encode_sampled(one.repartition(7), PATH, sharpness=0.3).collect()
    assert sorted((str(r.doc_id), r.ids) for r in first if r.ids is not None) == sorted((str(r.doc_id), r.ids) for r in other if r.ids is not None)
    assert len(first) == len(other) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in first:
        text = by_id[r.doc_id]
        assert r.decoded == text
        assert (r.ids is None) == (text is None) == (r.log_prob is None) and r.lossless is (None if text is None else True)
        assert text is None or (len(r.ids) == 4 * r.n_pieces and zlib.crc32(r.ids) == r.ids_crc32)
    reseeded = pieces.encode_sampled(one, PATH, sharpness=0.3, seed=1).collect()
    assert sorted(str(r.ids) for r in reseeded) != sorted(str(r.ids) for r in first)
    assert pieces.encode_sampled(one.limit(0), PATH).collect() == []


def test_sharp_weights_agree_with_short_segmentations(lattice):
    ids, _ = lattice.sample(["the the the"], np.array([1]))
    assert len(ids[0]) <= 6


def test_a_word_has_the_same_lattice_alone_and_among_others(lattice):
    rnd = random.Random(2)
    words = list(dict.fromkeys("▁" + "".join(rnd.choice("abcdeorsthinäß漢") for _ in range(rnd.randint(1, 14))) for _ in range(1500)))
    node0, _, within, start, code, logp, first_arc = lattice.build(words)
    arcs = np.concatenate([first_arc[1:], [len(code)]])
    for k in range(0, len(words), 7):
        alone = lattice.build([words[k]])
        a, b = first_arc[node0[k]], arcs[node0[k + 1] - 1]
        for got, want, shift in ((within, alone[2], 0), (start, alone[3], node0[k]), (code, alone[4], 0), (logp, alone[5], 0)):
            assert (got[a:b] - shift == want).all() and len(got[a:b]) == len(want)
