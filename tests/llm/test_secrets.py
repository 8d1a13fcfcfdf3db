import hashlib
import random
import re

from spectraloom.llm import secrets

SCHEMA = "doc_id bigint, text string, lang string, spans string, n_hex string"
KEY = "PzSfldfAd0rX432CuFc1nTKSbrCXEeIV"


def texts():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefio") for _ in range(rnd.randint(2, 9)))
    out = [
        None, "", "é password = 'abc123' x", "PASSWD:\"a/b+c.d-e_f=\"", "token=short", "api_key : abcdefg apikey=1234567",
        "AKIA" + "A" * 15, "AKIA" + "B7" * 8, "x" + "0a" * 12 + "g", "0123456789abcdef" * 3 + " \U0001f600 " + "f" * 24,
        f"see {KEY} here", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "keitlichenlichkeitbehaft", "1" * 30, "ſecret=abcdefgh",
        "secret=token=abcdef", "a" * 5000 + "=", "password" + " " * 500 + "=" + " " * 50 + "abcdef",
    ]
    return out + [" ".join(word() for _ in range(50)) for _ in range(20)] + [f"see {KEY} here"]


def brute_base(text):
    found = []
    pattern = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(texts())] + [(None, "token=abcdef", None, None, None)]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        base = brute_base(text or "")
        kinds = [k for _, k, _ in base]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(secrets.joined(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("random")] == [s for s in secrets.joined(base).split(",") if s]
    assert got[10].spans == f"random:4:{4 + len(KEY)}"
    for i in (11, 12, 13):
        assert "random" not in got[i].spans


def test_battery_is_calibrated_on_random_strings_and_rejects_structure():
    rnd = random.Random(2)
    letters = secrets.ALPHABETS["base62"]
    p = [secrets.battery("".join(rnd.choice(letters) for _ in range(40)), "base62") for _ in range(800)]
    assert 0.3 < sum(x > 0.5 for x in p) / len(p) < 0.7 and sum(x < 0.01 for x in p) < 40
    assert secrets.battery("ab1" * 12, "base36") < 1e-4


def test_limits_follow_the_expected_share():
    counts = {("hex", 1, b): 10 for b in range(secrets.BINS)}
    assert secrets.limits_of(counts)[("hex", 1)] == secrets.LEVEL
    mixed = {("hex", 1, b): 10 + (3000 if b < 30 else 0) for b in range(secrets.BINS)}
    assert secrets.limits_of(mixed)[("hex", 1)] >= 0.25


def test_redaction_keeps_rows_and_clean_texts(spark):
    docs = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(texts())], SCHEMA)
    got = secrets.redact_secrets(docs)
    assert got.columns == [*docs.columns, "has_secret"]
    for r in got.collect():
        before = texts()[r.doc_id]
        assert (r.text == before) == (before is None or not (brute_base(before) or KEY in before))
        assert r.text is None or not brute_base(r.text)
        assert r.has_secret == (r.text != before)
    assert secrets.scan_secrets(docs.limit(0)).collect() == []


def test_copies_of_a_text_change_no_other_span(spark):
    rnd = random.Random(6)
    letters = secrets.ALPHABETS["base62"]
    keys = ["".join(rnd.choice(letters) for _ in range(40)) for _ in range(200)]
    ordinary = next(k for k in iter(lambda: "".join(rnd.choice(letters) for _ in range(40)), "") if 0.28 < secrets.battery(k, "base62") < 0.31)
    rows = [(i, f"key {k} end", "en", "x", "y") for i, k in enumerate(keys)]
    spans = lambda copies: {
        r.doc_id: r.spans
        for r in secrets.scan_secrets(spark.createDataFrame(rows + [(1000 + i, f"see {ordinary}", "en", "x", "y") for i in range(copies)], SCHEMA)).collect()
        if r.doc_id <= 1000
    }
    assert spans(5000) == spans(1)
    assert sum(bool(x) for x in spans(1).values()) > 180


def test_keys_beside_paths_and_hyphens_are_found(spark):
    rnd = random.Random(8)
    make = lambda letters: "".join(rnd.choice(letters) for _ in range(40))
    cases = []
    for before, after, name in (("user-files/", "", "base62"), ("team_x/", "/y", "base64url"), ("a/b-", "-c", "base64"), ("a/b-", "-c/d", "base62")):
        key = next(k for k in iter(lambda: make(secrets.ALPHABETS[name]), "") if secrets.battery(k, name) > 0.3)
        cases.append((f"see {before}{key}{after} end", key))
    cases.append(("see some-plain/path_of/words-and/more_words-only end", None))
    rows = [(i, t, "en", "x", "y") for i, (t, _) in enumerate(cases)]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (text, key) in enumerate(cases):
        if key is None:
            assert got[i] == ""
        else:
            (span,) = got[i].split(",")
            kind, start, end = span.split(":")
            assert kind == "random" and int(start) <= text.index(key) and text.index(key) + len(key) <= int(end)
    clean = secrets.redact_secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(key is None or key not in {r.doc_id: r.text for r in clean}[i] for i, (_, key) in enumerate(cases))
