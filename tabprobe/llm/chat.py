"""Chat formatting with typed content parts, in SQL functions only.

A turn's content is an array of typed parts: ``struct<kind, text, ref, size>``
with kind ``text``, ``image``, ``audio`` or ``document``. A visitor flattens
the parts in order: text is escaped, any other part becomes a placeholder
``<|kind:i|>`` (``i`` counts the conversation's attachments), and its reference
and expanded token count go to the ``attachments`` list in the same order.
Plain text columns are wrapped as one text part.

Template: ``<|role|>`` line feed, content, ``<|end|>`` line feed. In texts and
roles ``%`` is written ``%25``, ``<`` as ``%3C`` and line feeds of roles as
``%0A``, so no text can hold a control string, and the escape is undone exactly.
``parse`` reads turns back from the formatted string alone; ``loss`` marks the
assistant contents.

Scale: one shuffle by conversation, no Python. A conversation is one formatted
string by contract, so its turns meet in one row; conversations, however many,
are spread by key.

Defined results: null text or null parts are empty; a null role is an empty
role; unknown part kinds keep their name in the placeholder; turns are ordered by
turn number (null first), ties and repeated rows by role and text, and all are
kept; rows with a null conversation id form one conversation; empty input gives
no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,size:bigint>"
IMAGE_TOKENS = 256  # per image
AUDIO_TOKENS_PER_SECOND = 25  # size of an audio part: milliseconds
DOCUMENT_CHARS_PER_TOKEN = 4  # size of a document part: characters
_END = "<|end|>\n"


def escape(c: Column) -> Column:
    """Reversible: ``%`` first, then the sign every control string begins with."""
    return F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def _escape_name(c: Column) -> Column:
    """Roles and kinds stand on one line."""
    return F.replace(escape(c), F.lit("\n"), F.lit("%0A"))


def text_part(c: Column) -> Column:
    """A plain text as content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), c.cast("string").alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"))).cast(f"array<{PART}>")


def expanded_tokens(p: Column) -> Column:
    """Tokens that an attachment stands for."""
    size = F.coalesce(p["size"], F.lit(0).cast("long"))
    return (F.when(p["kind"] == "image", F.lit(IMAGE_TOKENS).cast("long"))
             .when(p["kind"] == "audio", F.ceil(size * AUDIO_TOKENS_PER_SECOND / 1000).cast("long"))
             .when(p["kind"] == "document", F.ceil(size / DOCUMENT_CHARS_PER_TOKEN).cast("long"))
             .otherwise(F.lit(0).cast("long")))


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def _visit(parts: Column, before: Column) -> Column:
    """The content string of one turn; ``before``: attachments of earlier turns."""
    def one(p, i):
        number = before + F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: ~_is_text(q)))
        mark = F.concat(F.lit("<|"), _escape_name(p["kind"]), F.lit(":"),
                        number.cast("string"), F.lit("|>"))
        return F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)
    return F.array_join(F.transform(parts, one), "")


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str | None = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, attachments
    (array<struct<number, kind, ref, tokens>>) and attachment_tokens."""
    parts = F.col(parts_col).cast(f"array<{PART}>") if parts_col else text_part(F.col(text_col))
    parts = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"),
                        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), parts.alias("parts")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def turn(t, i):
        before = F.aggregate(F.slice(F.col("t"), F.lit(1), i), F.lit(0), lambda acc, x: acc + F.size(F.filter(x["parts"], lambda p: ~_is_text(p))))
        return F.concat(F.lit("<|"), _escape_name(t["role"]), F.lit("|>\n"), _visit(t["parts"], before if parts_col else F.lit(0)), F.lit(_END))
    files = F.flatten(F.transform("t", lambda t: F.filter(t["parts"], lambda p: ~_is_text(p))))
    files = F.transform(files, lambda p, i: F.struct((i + 1).alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"),
                                                     expanded_tokens(p).alias("tokens")))
    return conv.select("conv_id", F.array_join(F.transform("t", turn), "").alias("formatted"),
                       files.alias("attachments"),
                       F.aggregate(files, F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]).alias("attachment_tokens"))


def parse(formatted: str = "formatted") -> Column:
    """Turns read back from the string: array<struct<role, text, loss>>, texts
    unescaped, placeholders of attachments as they stand."""
    body = F.split(F.col(formatted), r"<\|end\|>\n", -1)
    bodies = F.slice(body, 1, F.size(body) - 1)

    def one(b):
        head = F.instr(b, F.lit("|>\n"))
        role = unescape(F.replace(b.substr(F.lit(3), head - 3), F.lit("%0A"), F.lit("\n")))
        text = unescape(b.substr(head + 3, F.length(b)))
        return F.struct(role.alias("role"), text.alias("text"), (role == "assistant").alias("loss"))
    return F.transform(bodies, one)


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the assistant texts in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["loss"]), lambda t: t["text"]), "")
