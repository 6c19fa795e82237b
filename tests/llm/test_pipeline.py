"""The pipeline's stages on a small folder: what goes, what stays, and which columns come out."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402

from reelscope.llm import pieces, queries, simhash, winnow  # noqa: E402
from reelscope.llm.common import table  # noqa: E402
from test_corpus import brute_overlap  # noqa: E402
from test_jaccard import brute  # noqa: E402

PLACE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    if not os.path.isdir(PLACE):
        pytest.skip("benchmark tables are not here")
    docs = [table(spark, PLACE, "documents").cache()]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stage(spark, docs[-1], PLACE).cache())
    return docs


def test_columns_and_whole_rows(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
        assert df.exceptAll(stages[0]).count() == 0
    assert stages[-1].count() == stages[-2].count()


def test_language_and_quality_keep_good_documents(spark, stages):
    labels = table(spark, PLACE, "labels")
    good = stages[1].join(labels.where("quality = 1"), "doc_id").count()
    assert stages[2].join(labels.where("quality = 1"), "doc_id").count() >= 0.98 * good
    bad = stages[1].join(labels.where("quality = 0"), "doc_id").count()
    assert stages[2].join(labels.where("quality = 0"), "doc_id").count() <= 0.2 * bad
    assert stages[1].count() >= 0.98 * stages[0].where(F.length("text") > 20).count()


def test_near_copies_against_brute_force(stages):
    """Five-word shingles, a Jaccard similarity of 0.8 or more: of each component the smallest id stays."""
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    roots = brute(rows, 5, (4, 5), empty_alike=True)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({root for _, root in roots.values()})


def test_decontamination_against_brute_force(spark, stages):
    items = [(r.item_id, r.text) for r in table(spark, PLACE, "benchmark").collect()]
    want = sorted(r.doc_id for r in stages[3].collect() if not brute_overlap(r.text, items)[1])
    assert sorted(r.doc_id for r in stages[4].collect()) == want


def test_ids_decode_to_the_texts(stages):
    model = pieces.PieceModel(queries.tokenizer_file("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        assert model.decode(list(r.ids)) == texts[r.doc_id]


def test_extra_columns_nulls_and_empty_input(spark):
    rows = [(1, "some words that are here to be read by everyone who can", "en", None, 5, "x"), (None, None, None, None, None, None), (2, "", None, "s", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, PLACE)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, df, PLACE).collect()
    assert simhash.representatives(docs).count() == 2 and winnow.clean(docs, table(spark, PLACE, "benchmark")).count() >= 2
