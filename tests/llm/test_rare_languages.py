"""Languages with few rows get a model; texts in none are not accepted as another."""

import random

from reelscope.llm import language

LETTERS = {"aa": "aeioustr", "bb": "klmnopyz", "cc": "bcdfghju"}


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_rare_language_and_texts_in_none(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, LETTERS["aa"], 4), "aa", "s") for i in range(30_000)]
    rows += [(40_000 + i, words(rng, LETTERS["bb"], 30), "bb", "s") for i in range(50)]  # under 0.2 % of the rows
    rows += [(50_000 + i, words(rng, LETTERS["cc"], 30), "cc", "s") for i in range(20)]  # too few for a model
    rows += [(60_000 + i, words(rng, "qwxvöéñç", 30), None, "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(8)
    model = language.fit_text_model(docs)
    assert model.languages == ["aa", "bb", language.BACKGROUND]
    kept = {r.doc_id // 10_000 for r in language.accepted_documents(docs.where("doc_id >= 40000"), model).select("doc_id").collect()}
    assert kept == {4}
    got = language.accepted_documents(docs, model).select("doc_id").collect()
    assert sum(40_000 <= r.doc_id < 50_000 for r in got) == 50 and not any(r.doc_id >= 50_000 for r in got)
    assert sum(r.doc_id < 30_000 for r in got) >= 29_900
