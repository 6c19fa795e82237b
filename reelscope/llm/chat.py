"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds parts (kind, text, ref, tokens).  The visitor turns text parts into escaped text and image,
audio and document parts into placeholders ``<|kind:turn.part|>`` in their order, and records what they
refer to and how many tokens each stands for.  The template of a turn is
``<|turn|>role<|body|>parts<|end|>``; roles and texts are escaped, so no control string in them is one.  Text parts that
follow one another are escaped as one text, as a control string may begin in one and end in the next; they
share one loss span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
MEDIA = ("image", "audio", "document")
#: Control strings of this template and of common others: "<|", "<s>", "</s>", "[INST]", "[/INST]".
#: Escaping puts one backslash behind the first character, behind any number that is there already.
OPENING, CLOSING = r"([<\[])", r"(\||/?s>|/?INST\])"
PARTS = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, OPENING + r"(\\*)" + CLOSING, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, OPENING + r"\\(\\*)" + CLOSING, r"$1$2$3")


def text_part(text: Column) -> Column:
    """The parts of a plain message: one text."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("tokens")))


def visited(parts: Column, turn: Column, loss: Column) -> Column:
    """The parts as (s, loss): escaped text, or a placeholder; parts of other kinds and null parts are empty.

    Neighbouring text parts (empty ones between them do not part them) become one piece.
    """
    blank = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("s"))

    def one(p: Column, i: Column) -> Column:
        mark = F.concat(F.lit("<|"), p["kind"], F.lit(":"), turn.cast("string"), F.lit("."), (i + 1).cast("string"), F.lit("|>"))
        media = F.struct(F.lit("media").alias("kind"), mark.alias("s"))
        text = F.struct(F.lit("text").alias("kind"), F.coalesce(p["text"], F.lit("")).alias("s"))
        return F.when(p["kind"] == "text", text).when(p["kind"].isin(*MEDIA), media).otherwise(blank("none"))

    said = F.filter(F.transform(parts, one), lambda p: p["kind"] != "none")
    kind = "array<struct<kind:string,s:string>>"

    def joined(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        merged = F.array(F.struct(F.lit("text").alias("kind"), F.concat(last["s"], p["s"]).alias("s")))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), merged)
        return F.when((F.size(acc) > 0) & (last["kind"] == "text") & (p["kind"] == "text"), grown).otherwise(F.concat(acc, F.array(p)))

    runs = F.aggregate(said, F.array().cast(kind), joined)
    return F.transform(runs, lambda p: F.struct(F.when(p["kind"] == "text", escaped(p["s"])).otherwise(p["s"]).alias("s"), F.coalesce(loss & (p["kind"] == "text"), F.lit(False)).alias("loss")))


def formatted(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: Column | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start from 0 and length, in code points, one per
    run of text parts of a learned role, in order), attachments (turn, part, kind, ref, tokens), expanded_tokens.

    Turns are ordered by (turn, role, parts): a null turn comes first, repeated rows are separate turns.  Null roles,
    texts and part lists are empty.  Null conversation ids form one conversation.  A conversation is one row, so
    it must fit in memory; the rows of all conversations are dealt by id.
    """
    parts = F.coalesce(parts if parts is not None else text_part(F.col("text")), F.array().cast(PARTS))
    rows = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), parts.cast(PARTS).alias("parts")).alias("message"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("turns"))
    plain = lambda text: F.struct(text.alias("s"), F.lit(False).alias("loss"))

    def pieces(m: Column, t: Column) -> Column:
        head = F.concat(F.lit(TURN), escaped(m["role"]), F.lit(BODY))
        return F.concat(F.array(plain(head)), visited(m["parts"], t + 1, m["role"].isin(*learn)), F.array(plain(F.lit(END))))

    def attached(m: Column, t: Column) -> Column:
        numbered = F.transform(m["parts"], lambda p, i: F.struct((t + 1).alias("turn"), (i + 1).alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
        return F.filter(numbered, lambda a: a["kind"].isin(*MEDIA))

    cut = whole.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("pieces"), F.flatten(F.transform("turns", attached)).alias("attachments"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        size = F.length(p["s"]).cast("bigint")
        span = F.struct(acc["at"].alias("start"), size.alias("length"))
        return F.struct((acc["at"] + size).alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    tokens = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0).cast("bigint")))
    return cut.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("loss_spans"), "attachments", tokens.alias("expanded_tokens"),
    )


def read_back(output: DataFrame) -> DataFrame:
    """(conv_id, turns of (role, body), loss_text, formatted_chars) from formatted rows alone; bodies are unescaped, with placeholders."""
    def one(segment: Column) -> Column:
        halves = F.split(F.substring(segment, len(TURN) + 1, 2**31 - 1), r"<\|body\|>", 2)
        return F.struct(unescaped(F.get(halves, F.lit(0))).alias("role"), unescaped(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("body"))

    segments = F.split("formatted", r"<\|end\|>")
    whole = F.transform(F.slice(segments, F.lit(1), F.size(segments) - 1), one)
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return output.select("conv_id", whole.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def digest(output: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), "")
    return read_back(output).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
