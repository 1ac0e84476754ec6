"""Chat formatting with typed content parts, in DataFrame functions only.

A turn is a list of parts. A visitor flattens it in order: text is escaped, every
other part becomes a placeholder, and an attachment record keeps its reference and
the number of tokens it expands to. Markers can't be forged: control strings inside
texts are escaped, and ``read_back`` undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: (as in a text, as written), applied in this order and undone in the reverse one.
#: Control strings of this and of other common templates.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("[INST]", "&lb;INST]"), ("[/INST]", "&lb;/INST]"))
_BACK = (("&nl;", "\n"), ("&lb;", "["), ("&lt;", "<"), ("&amp;", "&"))
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"
#: Tokens of a part: a fixed number, and as many for each unit (tile, second, page).
EXPANSION = {"image": (1, 256), "audio": (2, 25), "document": (2, 800)}


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for written, plain in _BACK:
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    absent = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), absent.cast("string").alias("ref"), absent.cast("int").alias("units"))).cast(PARTS)


def _tokens(part: Column) -> Column:
    """Tokens that an attachment expands to; 0 for a type without an entry."""
    units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
    value = F.lit(0)
    for kind, (fixed, each) in EXPANSION.items():
        value = F.when(part["type"] == kind, F.lit(fixed) + units * each).otherwise(value)
    return value.cast("long")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens.

    ``loss_spans`` are (start, length) in code points of ``formatted``, one for each
    turn of the trained role, over its escaped content. ``attachments`` are (turn,
    part, type, ref, tokens) in order of appearance; the placeholder of one is
    ``<|type:turn.part|>`` with places counted from 0. NULL roles, texts and part
    lists count as empty, NULL part types as text. Turns that tie are ordered by role
    and content, repeated rows are turns of their own, NULL turns come first, and a
    NULL conversation id is a conversation. No rows give no rows; other columns are
    ignored.
    """
    content = F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS))
    flat = F.array_join(
        F.transform(
            F.col("content"),
            lambda p, i: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), F.replace(escape(p["type"]), F.lit("|>"), F.lit("|&gt;")), F.lit(":"), F.col("place").cast("string"), F.lit("."), i.cast("string"), F.lit("|>"))),
        ),
        "",
    )
    attached = F.filter(
        F.transform(F.col("content"), lambda p, i: F.struct(F.col("place").alias("turn"), i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"), _is_text(p).alias("plain"))),
        lambda a: ~a["plain"],
    )
    in_order = Window.partitionBy("conv_id").orderBy("turn", "speaker", F.to_json("content"))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("speaker"), content.alias("content"))
    placed = (
        rows.withColumn("place", F.row_number().over(in_order) - 1)
        .withColumn("head", F.concat(F.lit(START), F.replace(escape(F.col("speaker")), F.lit("\n"), F.lit("&nl;")), F.lit("\n")))
        .withColumn("body", flat)
        .withColumn("attached", attached)
        .withColumn("written", F.concat("head", "body", F.lit(END + "\n")))
        .withColumn("start", F.coalesce(F.sum(F.length("written").cast("long")).over(so_far), F.lit(0)))
    )
    span = F.when(F.col("speaker") == trained_role, F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "written", span.alias("span"), "attached"))).alias("turns"))
    return gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform(F.flatten(F.transform("turns", lambda t: t["attached"])), lambda a: F.struct(a["turn"], a["part"], a["type"], a["ref"], a["tokens"])).alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) and ``loss_text``, both read from the formatted string alone."""
    segments = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > 0)
    body = lambda s: F.substring_index(F.substr(s, F.instr(s, "\n") + 1), END, 1)
    turns = F.transform(segments, lambda s: F.struct(unescape(F.substring_index(s, "\n", 1)).alias("role"), unescape(body(s)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))


def digest(read: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "attachment_tokens",
    )
