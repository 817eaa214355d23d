"""Chat formatting: typed content parts to one marked string per conversation, with loss mask and attachments.

A message holds an ordered array of parts. A visitor turns each part into text: text parts are escaped, attachments become
one placeholder ``<|part_kind|>`` each, so that no kind can write a string of the template, and what the placeholder stands for
(reference, expanded token count) is recorded in order. Every turn
is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.

Escaping is reversible: in texts and roles a backslash is put after every ``<`` that is followed by any number of backslashes
and a bar, so that ``<|`` only ever comes from the template; line ends in a role become ``<|nl|>``.

Everything is a DataFrame expression: one shuffle by conversation, no Python. A conversation is one output row, and so one
group; its size is that of the row asked for.

Defined results: null text is empty, a null role is the empty role, a null or empty part array an empty text, a null
conversation id a conversation of its own; a part of unknown kind is an attachment of that kind. Turns are ordered by turn,
nulls first, then role and text, so ties and repeated rows come in a fixed order and all are kept. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

# Parameters of the expanded token counts.
PATCH = 28  # pixels at a side of an image patch
AUDIO_RATE = 25.0  # tokens per second of audio
PAGE_TOKENS = 1024  # tokens per document page


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def text_part(text: Column) -> Column:
    """An array of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def visit(part: Column) -> Column:
    """The text that stands for a part."""
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|part_"), F.regexp_replace(part["kind"], "[^0-9A-Za-z_]", "_"), F.lit("|>"))
    )


def expanded_tokens(part: Column) -> Column:
    """How many tokens a placeholder grows to: patches of an image, time steps of audio, pages of a document; else one."""
    def patches(side: str) -> Column:
        return F.ceil(F.coalesce(part[side], F.lit(0)) / F.lit(PATCH))

    return (
        F.when(part["kind"] == "image", F.greatest(patches("width") * patches("height"), F.lit(1)))
        .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(1)))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS, F.lit(1)))
        .otherwise(F.lit(1)).cast("bigint")
    )


def format_chat(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``messages(conv_id, turn, role, parts)`` to one row per conversation.

    Returns conv_id, n_turns, formatted, segments (the pieces of ``formatted`` in order, each with its loss flag),
    attachments (kind, ref, tokens; in order of their placeholders) and attachment_tokens.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    attachments = F.transform(
        F.filter(parts, lambda p: ~is_text(p)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
    )
    turns = messages.select(
        "conv_id", "turn", escape_role(F.col("role")).alias("role"), F.array_join(F.transform(parts, visit), "").alias("body"),
        attachments.alias("attachments"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"),
    )
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "body", "attachments", "loss"))).alias("turns")
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit(OPEN), t["role"], F.lit("\n")), no), segment(t["body"], t["loss"]), segment(F.lit(CLOSE), no)
    )))
    attached = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    return grouped.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), segments.alias("segments"), attached.alias("attachments")
    ).select(
        "*", F.array_join(F.col("segments")["text"], "").alias("formatted"),
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, unescaped."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        inner = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(CLOSE))
        return F.struct(unescape_role(role).alias("role"), unescape(inner).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
