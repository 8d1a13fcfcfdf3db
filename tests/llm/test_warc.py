import base64
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, top string, digest int, value string, path string"
END = "\r\n\r\n"


def record(payload, kind="response", extra=""):
    n = len(payload.encode())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{n}:x>\r\n{extra}Content-Length: {n}\r\n\r\n{payload}{END}"


def pages():
    nested = record("inner") + record("another " * 9)
    texts = ["<p>a</p>", "", None, "ß" * 70, nested, "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n", "WARC/1.1\r\n" * 40, "x" * 5000, END * 3]
    texts += [record("trap") * 30, "WARC/1.1\r\n" + "long line without colon " * 90, "WARC/1.1\r\nA: " + "b" * 9000, nested + "Content-Length: 7"]
    rows = [(i, f"http://e.org/{i}", t) for i, t in enumerate(texts)]
    rows += [(100 + i, None if i % 2 else "a\r\nContent-Length: 1\n", "copy of many") for i in range(60)]
    rows += [(300 + i, "u", f"text {i // 3}") for i in range(90)]
    rows += [(-5, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "u", "only null ids"), (None, "v", "only null ids")]
    rows += [(389, "u", "text 29"), (700, "u", "")]
    return [(*r, "t", 1, "v", "p") for r in rows]


def brute(rows):
    top = {}
    for i, _, t, *_ in rows:
        t = t or ""
        top[t] = max((x for x in (i, top.get(t)) if x is not None), default=None)
    out = []
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        response = top[t or ""] == i
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), sha, "response" if response else "revisit", None if response else top[t or ""]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk, heavy", [(61, 1000), (700, 3), (1 << 20, 1000)])
def test_round_trip_equals_brute_force(spark, chunk, heavy, monkeypatch):
    monkeypatch.setattr(warc, "HEAVY", heavy)
    monkeypatch.setattr(warc, "WINDOW", 50 if chunk == 61 else 1 << 18)
    monkeypatch.setattr(warc, "READ", 37 if chunk == 61 else 1 << 20)
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    got = warc.round_trip(df, chunk)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(pages())


def test_payloads_urls_and_files_as_written(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(2), folder, min_payload=4)
    got = warc.read_archives(spark, folder, chunk=997, with_payload=True).collect()
    assert len(got) == len(pages())
    small = [r for r in got if r.payload_length < 4]
    assert small and all(r.record_type == "response" and r.refers_to is None for r in small)
    for r in got:
        assert r.payload_digest == r.read_digest if r.record_type == "response" else r.read_bytes == 0
        assert "\n" not in (r.target_uri or "")
    ids = {r.record_id for r in got if r.record_type == "response"}
    assert all(r.refers_to in ids for r in got if r.record_type == "revisit")
    texts = sorted(r.payload.decode() for r in got if r.record_type == "response")
    assert set(texts) == {t or "" for _, _, t, *_ in pages()}
    # a plain reader that follows lengths finds the same records
    n = 0
    for name in sorted(os.listdir(folder)):
        data = open(f"{folder}/{name}", "rb").read() if name.startswith("part-") else b""
        while data:
            head, _, rest = data.partition(END.encode())
            length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[length : length + 4] == END.encode()
            data, n = rest[length + 4 :], n + 1
    assert n == len(pages())
    assert all(r.length == r.verified for r in warc.verified(spark, folder, chunk=500).collect())


def test_a_broken_file_gives_what_lies_before(spark, tmp_path):
    whole = (record("one") + record("two " * 50) + record("three")).encode()
    cut, junk = whole[: -len(record("three")) + 30], record("one").encode() + b"junk" + record("lost").encode()
    for name, data in (("whole", whole), ("cut", cut), ("junk", junk), ("none", b"no record at all"), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    got = warc.read_archives(spark, str(tmp_path), chunk=64).groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).count()
    assert {r.f: r["count"] for r in got.collect()} == {"whole": 3, "cut": 2, "junk": 1}
    holds = {r.path.rsplit("/")[-1]: (r.length, r.verified) for r in warc.verified(spark, str(tmp_path), chunk=64).collect()}
    assert holds["whole"] == (len(whole), len(whole)) and holds["none"] == (16, 0) and "empty" not in holds
    assert holds["cut"][1] == len(record("one") + record("two " * 50)) and holds["junk"][1] == len(record("one"))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_inside_a_chunk_are_contracted():
    offsets = np.array([0, 5, 9, 20, 31])
    successors = np.array([5, 20, 30, 31, 45])
    assert warc.contracted(offsets, successors, 40).tolist() == [45, 45, 30, 45, 45]
    assert warc.contracted(offsets, successors, 31).tolist() == [31, 31, 30, 31, 45]
    assert warc.contracted(np.zeros(0, np.int64), np.zeros(0, np.int64), 10).tolist() == []
