"""Chat formatting from typed content parts, with built-in column functions only.

A message is a list of parts: text, image, audio or document. Each part becomes its
(escaped) text or a placeholder, in order; attachments are listed with their turn, place and
the number of tokens that their placeholder expands to. A conversation is one formatted
string of turns between control strings, with the spans that count for the loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: A backslash goes after the first character of each of these in a text or role, and before
#: each backslash; no control string can then be read in it.
CONTROL = r"(<)(?=\||/?s>|</?SYS>>)|(\[)(?=/?INST\])"
#: Sizes that one expanded token stands for: image pixels a side, audio milliseconds; a
#: document page counts a fixed number.
PATCH, AUDIO_STEP, PAGE_TOKENS = 14, 20, 256

PART = (
    "struct<type: string, text: string, ref: string, width: int, height: int, "
    "duration_ms: bigint, pages: int>"
)


def escape(text: Column) -> Column:
    """Reversible: see ``CONTROL``."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A message of one text part; null is empty."""
    none = {n: F.lit(None).cast(t) for n, t in (("width", "int"), ("height", "int"))}
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            none["width"].alias("width"),
            none["height"].alias("height"),
            F.lit(None).cast("bigint").alias("duration_ms"),
            F.lit(None).cast("int").alias("pages"),
        )
    )


def expanded_tokens(part: Column) -> Column:
    """How many tokens the placeholder of an attachment stands for; text has none here.
    Unknown sizes count one."""

    def steps(size: Column, step: int) -> Column:
        return F.greatest(F.ceil(F.coalesce(size, F.lit(1)) / F.lit(step)), F.lit(1))

    image = steps(part["width"], PATCH) * steps(part["height"], PATCH)
    pages = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PAGE_TOKENS
    return (
        F.when(part["type"] == "image", image)
        .when(part["type"] == "audio", steps(part["duration_ms"], AUDIO_STEP))
        .when(part["type"] == "document", pages)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def visit(part: Column) -> Column:
    """A part as it stands in the formatted text. Parts of another or no type are text."""
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(mark)).otherwise(out)
    return out


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation from rows of ``conv_id``, ``turn``, ``role`` and ``parts``
    (an array of ``PART``): ``formatted``, ``spans`` (of the content of every turn: start in
    ``formatted`` and in the turn, length, all in code points, and whether it counts for the
    loss), ``loss_spans`` (start and length of those that do), ``attachments`` (turn, part,
    type, ref, expanded tokens), ``n_turns``, ``n_expanded`` and ``formatted_chars``.

    Turns are ordered by ``turn`` (null first), ties by role and content; repeated rows stay.
    A null role or text is empty, a null id is a conversation of its own, a part list that is
    null or empty gives an empty turn, and an empty table gives no rows. Other columns of
    ``messages`` are not looked at.
    """
    role = escape(F.coalesce(F.col("role"), F.lit("")))
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    turns = messages.select(
        "conv_id",
        "turn",
        (F.coalesce(F.col("role"), F.lit("")) == loss_role).alias("in_loss"),
        F.concat(F.lit(TURN), role, F.lit(CONTENT)).alias("head"),
        F.array_join(F.transform(parts, visit), "").alias("body"),
        F.filter(
            F.transform(
                parts,
                lambda p, i: F.struct(
                    i.alias("part"),
                    p["type"].alias("type"),
                    p["ref"].alias("ref"),
                    expanded_tokens(p).alias("n_tokens"),
                ),
            ),
            lambda a: a["type"].isin(*PLACEHOLDERS),
        ).alias("found"),
    )
    size = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), "head", "body", F.to_json("found")
    )
    placed = turns.select(
        "conv_id",
        "in_loss",
        "head",
        "body",
        "found",
        F.row_number().over(order).alias("nth"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("at"),
    )
    rows = placed.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("nth", "at", "in_loss", "head", "body", "found")
            )
        ).alias("turns")
    )
    spans = F.transform(
        "turns",
        lambda t: F.struct(
            (t["at"] + F.length(t["head"])).alias("start"),
            F.length(t["head"]).alias("start_in_turn"),
            F.length(t["body"]).alias("length"),
            t["in_loss"].alias("in_loss"),
        ),
    )
    loss_spans = F.transform(
        F.filter(spans, lambda s: s["in_loss"]), lambda s: F.struct(s["start"], s["length"])
    )
    attached = F.flatten(
        F.transform(
            "turns",
            lambda t: F.transform(
                t["found"],
                lambda a: F.struct(
                    (t["nth"] - 1).alias("turn"),
                    a["part"].alias("part"),
                    a["type"].alias("type"),
                    a["ref"].alias("ref"),
                    a["n_tokens"].alias("n_tokens"),
                ),
            ),
        )
    )
    text = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    return rows.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(text, "").alias("formatted"),
        spans.alias("spans"),
        loss_spans.alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda a, x: a + x["n_tokens"]).alias(
            "n_expanded"
        ),
    ).withColumn("formatted_chars", F.length("formatted").cast("bigint"))


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand in it, control strings included."""
    return F.slice(F.split(formatted, r"(?=<\|turn\|>)"), 1, 2147483647)


def parse_turns(formatted: Column) -> Column:
    """Role and text of each turn, read back from a formatted conversation. Placeholders of
    attachments stay in the text."""
    return F.transform(
        turns_of(formatted),
        lambda t: F.struct(
            unescape(
                F.substring_index(F.substring_index(t, CONTENT, 1), TURN, -1)
            ).alias("role"),
            unescape(
                F.substring_index(F.substring_index(t, CONTENT, -1), END, 1)
            ).alias("text"),
        ),
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order; other turns give an empty text.
    Turns and spans go side by side, so the work grows with the conversation, not its square."""

    def text(turn: Column, span: Column) -> Column:
        content = F.substring(turn, span["start_in_turn"] + 1, span["length"])
        return F.when(span["in_loss"], unescape(content)).otherwise(F.lit(""))

    return F.zip_with(turns_of(formatted), spans, text)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from ``formatted`` and ``spans`` alone."""
    parsed = formatted.select(
        "conv_id",
        parse_turns(F.col("formatted")).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("spans")), "").alias("loss"),
        "formatted_chars",
    )
    lines = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return parsed.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
