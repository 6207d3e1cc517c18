"""Operator 5, native: chat formatting of typed content parts.

A turn holds parts: text, image, audio or document. A visitor (one expression a
kind) flattens a turn's parts into text and ordered placeholders, and records each
attachment's reference and the tokens it expands to. Turns then become one string
a conversation, with a loss mask over the assistant's text.

Every control string that occurs inside a text or role is escaped, reversibly:
U+241B becomes U+241B e, and the i-th control string becomes U+241B and the i-th code letter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

ESCAPE = "␛"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|body|>", "<image>", "<audio>", "<document>"]
CODES = "0123456789a"
TURN, BODY, END = "<|turn|>", "<|body|>", "</s>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e"))
    return reduce(lambda t, c: F.replace(t, F.lit(c[0]), F.lit(ESCAPE + c[1])), zip(CONTROL, CODES), text)


def unescaped(text: Column) -> Column:
    text = reduce(lambda t, c: F.replace(t, F.lit(ESCAPE + c[1]), F.lit(c[0])), zip(CONTROL, CODES), text)
    return F.replace(text, F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def attachment_tokens(part: Column) -> Column:
    """Tokens that a placeholder expands to: patches of an image, frames of audio, a fixed number for each page; 1 where the size is unknown."""
    image = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    kinds = {"image": image, "audio": F.ceil(part["seconds"] * AUDIO_RATE), "document": part["pages"].cast("long") * PAGE_TOKENS}
    return F.coalesce(reduce(lambda c, k: c.when(part["kind"] == k, kinds[k].cast("long")), kinds, F.when(part["kind"] == "text", F.lit(0).cast("long"))), F.lit(1).cast("long"))


def visited(part: Column) -> Column:
    """A part as text: its escaped text, or its kind's placeholder. Unknown kinds keep their text."""
    return F.when(part["kind"] == "image", "<image>").when(part["kind"] == "audio", "<audio>").when(part["kind"] == "document", "<document>").otherwise(escaped(F.coalesce(part["text"], F.lit(""))))


def formatted(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, parts array<PART>).

    formatted: the string. pieces: for each turn head_chars and body_chars, code points
    of its head (marker, role, marker) and of its escaped body, and loss, true if the body is under
    the loss mask. attachments: kind, ref and tokens in order. Turns stand in the order
    of (turn, role, escaped body); null roles, parts and texts count as empty, a null turn comes
    first, null conv_ids form one conversation. Repeated rows stay; very long texts are formatted whole; other
    columns are left out, whatever their names. An empty table gives none.
    """
    is_file = lambda p: p["kind"].isin("image", "audio", "document")
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    role = F.coalesce("role", F.lit(""))
    each = turns.select(
        "conv_id", "turn", role.alias("role"), F.array_join(F.transform(parts, visited), "").alias("body"),
        F.transform(F.filter(parts, is_file), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), attachment_tokens(p).alias("tokens"))).alias("files"),
    )
    # collect_list is partial on the map side; the order is made after it
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "body", "files"))).alias("t"))
    head = lambda x: F.concat(F.lit(TURN), escaped(x["role"]), F.lit(BODY))
    return whole.select(
        "conv_id",
        F.concat(F.lit("<s>"), F.array_join(F.transform("t", lambda x: F.concat(head(x), x["body"], F.lit(END))), "")).alias("formatted"),
        F.transform("t", lambda x: F.struct(F.length(head(x)).alias("head_chars"), F.length(x["body"]).alias("body_chars"), (x["role"] == "assistant").alias("loss"))).alias("pieces"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<role, text>, loss_text) parsed from the formatted string and its mask alone; placeholders stay as they are."""
    cut = F.slice(F.split(F.col("formatted"), r"<\|turn\|>", -1), 2, F.greatest(F.size("pieces"), F.lit(1)))
    rows = chats.select("*", cut.alias("_cut"))
    body = lambda s: F.substring(F.substring_index(s, BODY, -1), F.lit(1), F.length(F.substring_index(s, BODY, -1)) - len(END))
    turns = F.transform("_cut", lambda s: F.struct(unescaped(F.substring_index(s, BODY, 1)).alias("role"), unescaped(body(s)).alias("text")))
    under = F.zip_with("_cut", "pieces", lambda s, p: F.when(p["loss"], unescaped(F.substring(s, p["head_chars"] - len(TURN) + 1, p["body_chars"]))).otherwise(""))
    return rows.select("*", turns.alias("turns"), F.array_join(under, "").alias("loss_text")).drop("_cut")


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Rows of plain text as turns of one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return conversations.select("conv_id", "turn", "role", F.array(part.cast(PART)).alias("parts"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").union(own)
    chats = read_back(formatted(conversation_turns(rows)))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"),
    )
