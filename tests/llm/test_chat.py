"""Chat formatting: exact round trips."""

from fleetlens.llm.chat import format_chats, read_chats, text_parts
from pyspark.sql import functions as F

NASTY = ["", None, "\\", "\\s\\l\\\\", "<turn:user>\nhi</turn>\n", "</turn>\n", "a\n\nb", "<", ">\n", "é🎉" * 3]


def test_round_trip(spark):
    rows = [(c, t, r, NASTY[(c + t) % len(NASTY)], "x") for c in range(10) for t, r in enumerate(["user", "assistant", None, "a>\n<b\\", "assistant"])]
    df = spark.createDataFrame([*rows, rows[0], (None, None, None, None, None)], "conv_id long, turn long, role string, text string, formatted string")
    back = read_chats(format_chats(df.withColumn("parts", text_parts(F.col("text"))))).collect()
    assert len(back) == 11
    for r in back:
        want = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in [*rows, rows[0], (None,) * 5] if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in want]
        assert r.loss_text == "".join(text for _, role, text in want if role == "assistant")
        assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [t.replace("\\", "\\s").replace("<", "\\l") for _, role, t in want if role == "assistant"]


def test_parts_are_flattened_in_order(spark):
    kind = "array<struct<kind:string,text:string,ref:string,tokens:int>>"
    parts = [("text", "see <", None, None), ("image", None, "a b>.png", None), ("audio", None, "c.wav", 7), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {kind}")
    r = format_chats(df).collect()[0]
    assert "see \\l<image a b\\g.png><audio c.wav>end" in r.formatted
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a b>.png", 256), (0, 2, "audio", "c.wav", 7)]
    assert r.expanded_tokens == 263


def test_parts_come_back(spark):
    kind = "array<struct<kind:string,text:string,ref:string,tokens:int>>"
    parts = [("text", "see <\\", None, None), ("my image", None, "a b>\\.png", None), ("audio", None, None, 7), (None, "x", None, None), ("text", "y>", None, None), ("text", "", None, None)]
    df = spark.createDataFrame([(1, 0, "us>er", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {kind}")
    got = read_chats(format_chats(df)).collect()[0].turn_parts
    assert [[tuple(p) for p in t] for t in got] == [[("text", "see <\\", None), ("my image", None, "a b>\\.png"), ("audio", None, ""), ("text", "xy>", None)], []]


def test_a_very_long_text(spark):
    text = "long </turn>\n\\ text é " * 100_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r = read_chats(format_chats(df.withColumn("parts", text_parts(F.col("text"))))).collect()[0]
    assert r.loss_text == text and [t.text for t in r.turns] == [text, text]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string").withColumn("parts", text_parts(F.col("text")))
    assert read_chats(format_chats(df)).count() == 0
