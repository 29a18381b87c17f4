"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an array of parts (kind, text, uri, size).  The visitor turns
each part into text: text parts are escaped, every other part becomes one
placeholder such as ``<|image|>``; the i-th placeholder of a conversation
belongs to its i-th attachment.

Template of a turn: ``<|turn|>role<|text|>body<|end|>`` and a newline.  Inside
roles and texts ``\\`` becomes ``\\s`` and ``<`` becomes ``\\l``, so no marker can
occur there and the escape can be undone.

Defined cases: null or empty texts, parts and roles count as empty; a null
conversation id is a conversation of its own; equal turn numbers are ordered by
role, then by body, null turn numbers come first, repeated rows stay; an unknown
kind is an attachment named ``other``; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "struct<kind:string,text:string,uri:string,size:double>"
#: Tokens that one unit of an attachment expands to: a tile, a second, a page, a piece.
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 600.0, "other": 1.0}
WORDS = r"[^\x20\x09-\x0D]+"


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """One text part, for tables whose messages are plain texts."""
    none = F.lit(None).cast("string")
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), none.alias("uri"),
                    F.lit(None).cast("double").alias("size"))
    return F.array(part).cast(f"array<{PART}>")


def visit_parts(parts: Column, rates: Mapping[str, float] = TOKENS_PER_UNIT) -> dict[str, Column]:
    """body, attachments (kind, uri, tokens) and tokens of one message."""
    parts = F.coalesce(parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    parts = F.filter(parts, lambda p: p.isNotNull())
    known = [k for k in rates if k != "other"]

    def kind(p: Column) -> Column:
        return F.when(p["kind"].isin("text", *known), p["kind"]).otherwise(F.lit("other"))

    def tokens(p: Column) -> Column:
        rate = F.lit(float(rates["other"]))
        for name in known:
            rate = F.when(p["kind"] == name, F.lit(float(rates[name]))).otherwise(rate)
        return F.ceil(rate * F.greatest(F.coalesce(p["size"], F.lit(1.0)), F.lit(0.0))).cast("long")

    others = F.filter(parts, lambda p: kind(p) != "text")
    attachments = F.transform(others, lambda p: F.struct(
        kind(p).alias("kind"), p["uri"].alias("uri"), tokens(p).alias("tokens")))
    return {
        "body": F.array_join(F.transform(parts, lambda p: F.when(
            kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit("<|"), kind(p), F.lit("|>")))), ""),
        "attachments": attachments,
        "tokens": F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.when(
            kind(p) == "text",
            F.coalesce(F.regexp_count(p["text"], F.lit(WORDS)), F.lit(0)).cast("long")).otherwise(tokens(p))),
    }


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", learn_from: str = "assistant",
                rates: Mapping[str, float] = TOKENS_PER_UNIT) -> DataFrame:
    """One row per conversation: the formatted text and where to learn from it.

    Columns: conv_id, formatted, n_turns, loss_spans (turn_no, offset inside the
    turn, start inside formatted, length; in characters), attachments (turn_no,
    kind, uri, tokens) in the order of their placeholders, expanded_tokens.
    Offsets are running sums over a window, so no step rereads what stands before
    a turn; window and grouping share one shuffle by conversation.
    """
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                           F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.col(parts).alias("parts"))
    seen = visit_parts(F.col("parts"), rates)
    rows = rows.select("conv_id", "turn", "role", *[c.alias(n) for n, c in seen.items()])
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body", "tokens")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "conv_id", "tokens", "segment", "attachments",
        F.row_number().over(order).alias("turn_no"),
        F.coalesce(F.sum(F.char_length("segment").cast("long")).over(before), F.lit(0)).alias("before"),
        (F.char_length("head") - len(TURN)).alias("offset"), F.char_length("body").alias("length"),
        (F.col("role") == learn_from).alias("learn"))
    turns = F.sort_array(F.collect_list(F.struct("turn_no", "segment", "before", "offset", "length", "learn", "attachments")))
    rows = rows.groupBy("conv_id").agg(turns.alias("turns"), F.sum("tokens").alias("expanded_tokens"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(
        t["turn_no"].alias("turn_no"), t["offset"].alias("offset"),
        (t["before"] + len(TURN) + t["offset"]).alias("start"), t["length"].alias("length")))
    attached = F.flatten(F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(
        t["turn_no"].alias("turn_no"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
                       F.size("turns").cast("long").alias("n_turns"), spans.alias("loss_spans"),
                       attached.alias("attachments"), "expanded_tokens")


def read_chat(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) and ``loss_text``, both read from the formatted text alone."""
    marks = {n: m.replace("|", r"\|") for n, m in (("turn", TURN), ("text", TEXT), ("end", END + "\n"))}
    # what stands before the first marker is empty
    segments = F.slice(F.split("formatted", marks["turn"]), 2, 2**31 - 1)

    def parsed(segment: Column) -> Column:
        sides = F.split(segment, marks["text"], 2)
        return F.struct(unescape(sides[0]).alias("role"), unescape(F.split(sides[1], marks["end"])[0]).alias("text"))

    rows = formatted.withColumn("segments", segments)
    loss = F.transform("loss_spans", lambda s: unescape(
        F.substring(F.element_at("segments", s["turn_no"]), s["offset"] + 1, s["length"])))
    return rows.withColumns({"turns": F.transform("segments", parsed), "loss_text": F.array_join(loss, "")}).drop("segments")
