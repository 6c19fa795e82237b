"""A corpus cleaned and encoded in five stages; each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from reelscope.llm import jaccard, language, pieces, quality, simhash, toxicity, winnow
from reelscope.llm.common import staged, table
from reelscope.llm.queries import tokenizer_file


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undecided go (no letters to speak of, or evidence that cancels out)."""
    return language.accepted_documents(docs, language.fit_text_model(docs))


def qualities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose weighted neighbours are mostly of low quality go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id", 4, 2))
    return model.score(docs, out="_quality_score").where("_quality_score >= 0.5").drop("_quality_score")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the document with the smallest id stays.

    SimHash blocks find the closest copies; the exact join begins with what they link and finds the rest.
    """
    return simhash.representatives(docs, find=partial(jaccard.near_copies, words=5, share=(4, 5), empty_alike=True, simhash_first=True))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words running of a benchmark item (or the whole of a shorter one) go."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the best segmentation, their number, CRC-32 and score, and the four best scores."""
    parts = ("ids", "n_tokens", "ids_crc32", "score", "nbest_scores")
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), n=4, parts=parts, keep=["doc_id"])


STAGES = [
    ("language", languages),
    ("quality", qualities),
    ("near_copies", near_copies),
    ("decontamination", decontaminated),
    ("pieces", encoded),
]

#: No stage but the fourth can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
