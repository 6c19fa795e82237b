"""Control strings split over neighbouring text parts, media between them, very long conversations."""

import random

import pytest
from pyspark.sql import functions as F

from reelscope.llm import chat

CONTROL = ["<|end|>", "<|turn|>", "<|body|>", "<|image:1.1|>", "</s>", "<s>", "[INST]", "[/INST]", "<\\|end|>", "[\\\\INST]", "<", "|", "\\", "[", "x", "é", " "]
KIND = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,tokens:bigint>>, formatted string, turns int"


def text(value):
    return ("text", value, None, None)


def marks(turn, parts):
    """What a turn's body reads back as: texts as they are, media as placeholders, other kinds nothing."""
    out = ""
    for i, p in enumerate(parts, 1):
        if p and p[0] == "text":
            out += p[1] or ""
        elif p and p[0] in chat.MEDIA:
            out += f"<|{p[0]}:{turn}.{i}|>"
    return out


@pytest.mark.parametrize("media", [False, True])
def test_random_splits_round_trip(spark, media):
    rng = random.Random(5 + media)
    rows, want = [], {}
    for conv in range(150):
        turns = []
        for turn in range(rng.randrange(1, 4)):
            said = "".join(rng.choices(CONTROL, k=rng.randrange(8)))
            cuts = sorted(rng.choices(range(len(said) + 1), k=rng.randrange(5)))
            parts = [text(said[a:b]) for a, b in zip([0, *cuts], [*cuts, len(said)])]
            for _ in range(rng.randrange(3) if media else 0):
                parts.insert(rng.randrange(len(parts) + 1), rng.choice([("image", None, "a", 5), ("document", "x", "b", None), ("odd", "<|end|>", None, None), None, text(None)]))
            role = rng.choice(["assistant", "user", "<|end|>"])
            rows.append((conv, turn, role, parts, "clash", 7))
            turns.append((role, parts))
        want[conv] = turns
    out = chat.formatted(spark.createDataFrame(rows, KIND), parts=F.col("parts"))
    for r in chat.read_back(out).collect():
        assert [(t.role, t.body) for t in r.turns] == [(role, marks(i, parts)) for i, (role, parts) in enumerate(want[r.conv_id], 1)]
        assert r.loss_text == "".join((p[1] or "") for role, parts in want[r.conv_id] if role == "assistant" for p in parts if p and p[0] == "text")
    for r in out.collect():
        held = [p for _, parts in want[r.conv_id] for p in parts if p and p[0] in chat.MEDIA]
        assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [(p[0], p[2], p[3]) for p in held]
        assert r.expanded_tokens == sum(p[3] or 0 for p in held)


def test_long_conversation_and_long_text(spark):
    rows = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.when(F.col("id") == 7, F.repeat(F.lit("<|x"), 100_000)).otherwise("ok").alias("text"))
    r = chat.digest(chat.formatted(rows)).first()
    assert r.n_turns == 3000 and r.loss_chars == 2999 * 2 + 300_000
