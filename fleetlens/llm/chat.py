"""Chat formatting with typed content parts, in DataFrame functions alone.

A turn is ``<turn:ROLE>\\n`` + content + ``</turn>\\n``. Every control string begins with ``<`` and, inside a role or a
text, ``\\`` is written ``\\s``, ``<`` is written ``\\l``, in roles and placeholders ``>`` is written ``\\g`` and in kinds a space ``\\w``. So ``<`` begins a control string
wherever it stands, and each backslash begins exactly one escape: the way back is literal replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OPEN, _CLOSE = "<turn:", "</turn>\n"
#: Tokens that a part stands for where it does not say so itself.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _swap(c, ("\\", "\\s"), ("<", "\\l"))


def unescape(c: Column) -> Column:
    return _swap(c, ("\\w", " "), ("\\g", ">"), ("\\l", "<"), ("\\s", "\\"))


def text_parts(text: Column) -> Column:
    """One text part of a plain text; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def visit(part: Column) -> Column:
    """A part in the flat text: a text escaped, anything else a placeholder ``<KIND REF>``; null kinds are texts."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    name = lambda c: _swap(escape(F.coalesce(c, F.lit(""))), (">", "\\g"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), _swap(name(kind), (" ", "\\w")), F.lit(" "), name(part["ref"]), F.lit(">")))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment stands for; texts stand for none beyond their own."""
    default = F.lit(0)
    for kind, n in PART_TOKENS.items():
        default = F.when(part["kind"] == kind, F.lit(n)).otherwise(default)
    return F.coalesce(part["tokens"], default)


def format_chats(turns: DataFrame, parts: str = "parts", train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per conversation: conv_id, formatted, layout, loss_spans, attachments, expanded_tokens.

    ``turns`` has conv_id, turn, role and an array ``parts`` of (kind, text, ref, tokens). Turns go by turn, then role, then
    content, so that repeated rows and ties have one order; a null turn comes first, a null role is empty, a null or
    empty parts array is an empty content, and a null conv_id is a conversation of its own. loss_spans are (start, end)
    in code points of ``formatted`` over the content of ``train_roles``; layout has the same per turn (at, head, content,
    loss), the content's place being counted from the turn's own start. attachments are (turn, place, kind, ref, tokens) in
    order, and expanded_tokens is the sum of their tokens. Each turn is formatted before the shuffle, and a
    conversation is put together in one row, as its result is.
    """
    p = F.coalesce(F.col(parts), F.array().cast(turns.schema[parts].dataType))
    role = F.coalesce(F.col("role"), F.lit(""))
    content = F.concat_ws("", F.transform(p, visit))
    files = F.filter(F.transform(p, lambda x, i: F.struct(i.alias("place"), x["kind"].alias("kind"), x["ref"].alias("ref"), part_tokens(x).alias("tokens"))), lambda x: F.coalesce(x["kind"], F.lit("text")) != "text")
    each = turns.select(
        "conv_id", "turn", role.alias("role"), content.alias("content"), files.alias("files"),
        F.concat(F.lit(_OPEN), _swap(escape(role), (">", "\\g")), F.lit(">\n")).alias("head"),
    ).withColumns({"head_n": F.char_length("head"), "n": F.char_length("content")})
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("head_n") + F.col("n") + len(_CLOSE)).over(before), F.lit(0))
    whole = each.withColumn("at", at).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "turn", "role", "content", "files", "head", "head_n", "n"))).alias("ts"))
    layout = F.transform("ts", lambda t: F.struct(t["at"].alias("at"), t["head_n"].alias("head"), t["n"].alias("content"), t["role"].isin(*train_roles).alias("loss")))
    spans = F.transform(F.filter(layout, lambda x: x["loss"]), lambda x: F.struct((x["at"] + x["head"]).alias("start"), (x["at"] + x["head"] + x["content"]).alias("end")))
    attached = F.flatten(F.transform("ts", lambda t: F.transform(t["files"], lambda x: F.struct(t["turn"].alias("turn"), x["place"].alias("place"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id",
        F.concat_ws("", F.transform("ts", lambda t: F.concat(t["head"], t["content"], F.lit(_CLOSE)))).alias("formatted"),
        layout.alias("layout"),
        spans.alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """Reads ``formatted`` back: adds turns (role, text), loss_text (all text under the mask, unescaped) and turn_parts, of each turn
    the parts (kind, text, ref) with neighbouring texts as one and without empty ones; a null ref comes back empty."""
    cut = F.filter(F.split("formatted", "</turn>\\n"), lambda x: x != "")
    turns = F.transform(cut, lambda x: F.struct(
        unescape(F.substring_index(F.substr(x, F.lit(len(_OPEN) + 1)), ">\n", 1)).alias("role"),
        unescape(F.substr(x, F.locate(">\n", x) + 2)).alias("text"),
    ))
    kept = F.zip_with(cut, "layout", lambda x, y: F.when(y["loss"], F.substring(x, y["head"] + 1, y["content"])))
    none = F.lit(None).cast("string")
    inner = lambda y: F.substr(y, F.lit(2), F.char_length(y) - 2)
    part = lambda y: F.when(
        y.startswith("<"), F.struct(unescape(F.substring_index(inner(y), " ", 1)).alias("kind"), none.alias("text"), unescape(F.substr(inner(y), F.locate(" ", inner(y)) + 1)).alias("ref"))
    ).otherwise(F.struct(F.lit("text").alias("kind"), unescape(y).alias("text"), none.alias("ref")))
    parts = F.transform(cut, lambda x: F.transform(F.regexp_extract_all(F.substr(x, F.locate(">\n", x) + 2), F.lit("<[^>]*>|[^<]+"), 0), part))
    return chats.withColumns({"turns": turns, "loss_text": unescape(F.concat_ws("", kept)), "turn_parts": parts})
