import hashlib
import re

from pyspark.sql import functions as F

from spectraloom.llm import chat
from spectraloom.llm.queries import TRAP, chat_digests

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, seq string"
ROWS = [
    (1, 0, "system", "a\\<s>b\\\\"), (1, 2, "assistant", "x</s>y[/INST]"), (1, 1, "user", None), (1, 3, "assistant", "\U0001f600 é"),
    (2, 0, None, "only"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (None, 1, "user", "no id"),
    (4, 0, "assistant", "\\" * 5 + "[INST]" * 3 + "\n</s"), (5, 0, "user", "long " * 20000),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    out = set()
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)))
    return out


def test_round_trip_with_control_strings_nulls_and_ties(spark):
    rows = [(*r, "clash", "clash") for r in ROWS + TRAP]
    frame = spark.createDataFrame(rows, SCHEMA)
    finished = chat_digests(chat.messages_as_events(frame)).collect()
    assert {tuple(r)[:5] for r in finished} == expected(rows)
    assert len(finished) == len({r[0] for r in rows})
    # the same turns out of streamed deltas, edits and regenerations
    for size in (3, 200):
        streamed = chat_digests(chat.streamed(frame, size=size)).withColumn("conv_id", F.col("conv_id").cast("bigint"))
        assert sorted(map(str, streamed.collect())) == sorted(map(str, finished))


def test_the_log_of_a_stream(spark):
    frame = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "abcdefg"), (1, 1, "assistant", "")], "conv_id int, turn int, role string, text string")
    log = chat.streamed(frame, size=3)
    assert log.columns == [c.split()[0] for c in chat.LOG.split(", ")]
    kinds = {}
    for r in log.orderBy("seq").collect():
        kinds.setdefault(r.target if r.target else r.seq, []).append((r.kind, r.text))
    draft = [("delta", "a draft, "), ("delta", "assistant"), ("edit", "edited"), ("regenerate", None)]
    assert kinds == {
        1: [("message", "draft"), ("delta", "more"), ("edit", "ask")],
        2: [("message", None), *draft, ("delta", "")], 3: [("message", None), *draft, ("delta", "abc"), ("delta", "def"), ("delta", "g")],
    }


def test_control_strings_in_texts_never_stand_in_the_output(spark):
    rows = spark.createDataFrame([(*r, "", "") for r in ROWS + TRAP], SCHEMA)
    for r in chat.format_conversations(chat.fold_events(chat.messages_as_events(rows))).collect():
        turns = r.formatted.count("</s>")
        assert r.formatted.count("<s>[INST]") == r.formatted.count("<s>") == r.formatted.count("[INST]") == turns
        assert r.formatted.count("[/INST]") == turns
        for start, end in r.loss_spans:
            assert not re.search(r"</?s>|\[/?INST\]", r.formatted[start:end])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_digests(chat.messages_as_events(empty)).collect() == chat_digests(chat.streamed(empty)).collect() == []


def test_events_fold_in_order(spark):
    log = [
        ("c", 1, "message", None, "user", "hi"), ("c", 2, "message", None, "assistant", ""),
        ("c", 4, "delta", 2, None, "B"), ("c", 3, "delta", 2, None, "A"), ("c", 5, "regenerate", 2, None, None),
        ("c", 6, "delta", 2, None, "new"), ("c", 7, "edit", 1, None, "hello"), ("c", 8, "delta", 2, None, None),
        ("c", 9, "delta", 99, None, "lost"), (None, 1, "message", None, None, "x"), (None, 2, "delta", 1, None, "y"),
    ]
    got = chat.fold_events(spark.createDataFrame(log, chat.LOG)).collect()
    assert {tuple(r) for r in got} == {("c", 1, "user", "hello"), ("c", 2, "assistant", "new"), (None, 1, "", "xy")}
