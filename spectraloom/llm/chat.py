"""Chat logs folded into final messages and rendered for training, in DataFrame functions only.

A log has rows (conversation, sequence number, kind, target, role, text):

* `message`: opens the message that carries this sequence number;
* `delta`: appends its text to the message `target`;
* `edit`: replaces the text of `target`;
* `regenerate`: empties `target`; later deltas fill it anew.

Events are folded per message first and per conversation afterwards: a log in any order spreads a long
conversation over tasks until its messages are final. A log that already lies by conversation is shuffled no more. Template, per turn:

    <s>[INST]role[/INST]text</s>

The four control strings inside roles and texts are escaped with a backslash after their first
character, and backslashes are doubled; `unescape` undoes both exactly. The loss covers the escaped
text of assistant turns; its spans are code points of the formatted string, end exclusive.

Cases: NULL text or role is empty; NULL conversation ids form one conversation; events whose target
does not exist are dropped, since nothing says where they belong; equal sequence numbers are ordered
by kind, role and text and open one message each; repeated rows are repeated turns. An empty log
gives an empty result. Other columns are ignored, whatever their names.
"""

from pyspark.sql import Window, functions as F

ASSISTANT = "assistant"
TURN_END = "</s>"
LOG = "conv string, seq bigint, kind string, target bigint, role string, text string"


def escape(col):
    col = F.regexp_replace(col, r"\\", r"\\\\")
    return F.regexp_replace(col, r"(?:(<)(/?s>))|(?:(\[)(/?INST\]))", r"$1$3\\$2$4")


def unescape(col):
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def messages_as_events(rows, conv="conv_id", turn="turn", role="role", text="text"):
    """A table of finished turns as a log: every row opens a message."""
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("seq"), F.lit("message").alias("kind"),
        F.lit(None).cast("bigint").alias("target"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"),
    )


def streamed(rows, conv="conv_id", turn="turn", role="role", text="text", size=200):
    """A table of finished turns as the log that may have led to them.

    Rows of a conversation are numbered by turn, role and text. An assistant's message opens empty, streams a
    draft, is edited, is generated anew and streams its text in deltas of `size` characters; any other opens with
    a draft, gets one more delta and is edited to its text.
    """
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = rows.select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), text.alias("text"),
    )
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("bigint")
    rows = rows.withColumn("place", place)
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / size).cast("int") - 1, F.lit(0))),
        lambda i: F.struct(F.lit("delta").alias("kind"), F.substring(F.col("text"), i * size + 1, F.lit(size)).alias("text")),
    )

    def change(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"))

    draft = [change("delta", F.lit("a draft, ")), change("delta", F.col("role")), change("edit", F.lit("edited")), change("regenerate", F.lit(None).cast("string"))]
    changes = F.when(F.col("role") == ASSISTANT, F.concat(F.array(*draft), pieces)).otherwise(
        F.array(change("delta", F.lit("more")), change("edit", F.col("text")))
    )
    opened = F.struct(F.lit("message").alias("kind"), F.when(F.col("role") != ASSISTANT, F.lit("draft")).alias("text"))
    events = rows.select("conv", "place", "role", F.posexplode(F.concat(F.array(opened), changes)).alias("step", "event"))
    first = F.col("step") == 0
    # a message has its place as sequence number; all changes come later, in the order they were made
    return events.select(
        "conv", F.when(first, F.col("place")).otherwise(F.shiftleft(F.col("step").cast("bigint"), 32) + F.col("place")).alias("seq"),
        F.col("event.kind").alias("kind"), F.when(~first, F.col("place")).alias("target"), F.when(first, F.col("role")).alias("role"),
        F.col("event.text").alias("text"),
    )


def _fold(opened, changes):
    """Final text of one message from the text it opened with and its ordered changes.

    The last edit or regeneration decides what the text starts with; the deltas after it are joined at once.
    """
    last = F.coalesce(F.array_max(F.transform(changes, lambda e, i: F.when(e.kind != "delta", i))), F.lit(-1))
    start = F.when(last < 0, opened).when(F.get(changes, last)["kind"] == "edit", F.get(changes, last)["text"]).otherwise(F.lit(""))
    deltas = F.slice(changes, last + 2, F.size(changes))
    return F.concat(start, F.array_join(F.transform(deltas, lambda e: e.text), ""))


def fold_events(events):
    """(conv, seq, role, text): one row per final message of a log with the columns of `LOG`."""
    events = events.select(
        "conv", "seq", "kind", "target", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    # a message and its changes meet once; the log's own order of rows does not matter
    opens, number = F.col("kind") == "message", F.when(F.col("kind") == "message", F.col("seq")).otherwise(F.col("target"))
    changes = F.col("kind").isin("delta", "edit", "regenerate")
    of_message = events.filter(opens | (changes & F.col("target").isNotNull())).groupBy("conv", number.alias("message")).agg(
        F.collect_list(F.when(opens, F.struct("role", "text"))).alias("opened"),
        F.sort_array(F.collect_list(F.when(changes, F.struct("seq", "kind", "text")))).alias("changes"),
    )
    each = of_message.select("conv", F.col("message").alias("seq"), "changes", F.explode("opened").alias("o"))
    return each.select("conv", "seq", F.col("o.role").alias("role"), _fold(F.col("o.text"), F.col("changes")).alias("text"))


def format_conversations(messages):
    """(conv, formatted, loss_spans): one row per conversation of (conv, seq, role, text) messages."""
    turn = messages.select("conv", F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = turn.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t.role == ASSISTANT).alias("loss"),
                F.concat(F.lit("<s>[INST]"), escape(t.role), F.lit("[/INST]")).alias("head"),
                escape(t.text).alias("body"),
            ),
        ),
    ).drop("turns")
    lengths = F.transform(
        "parts",
        lambda p: F.struct(
            p.loss.alias("loss"), F.length(p["head"]).cast("bigint").alias("head"), F.length(p["body"]).cast("bigint").alias("body")
        ),
    )
    turns = turns.withColumn("lengths", lengths)
    # running start of every turn, appended one by one
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    spans = F.aggregate(
        "lengths",
        empty,
        lambda acc, p: F.struct(
            (acc["at"] + p["head"] + p["body"] + len(TURN_END)).alias("at"),
            F.when(
                p.loss,
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + p["head"]).alias("start"), (acc["at"] + p["head"] + p["body"]).alias("end"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "")
    return turns.select("conv", formatted.alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted):
    """array<struct<role, text>> of a formatted string."""
    pieces = F.split(formatted, TURN_END)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    cut = F.transform(turns, lambda t: F.split(F.substring(t, 10, 2**31 - 1), r"\[/INST\]", 2))
    return F.transform(cut, lambda c: F.struct(unescape(c[0]).alias("role"), unescape(c[1]).alias("text")))


def loss_texts(formatted, spans):
    """array<string>: the texts under the loss, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
