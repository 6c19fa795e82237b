"""Markup in linear time, posteriors against plain loops, dirty language columns, clashing columns, long pages."""

import random
import re
import time

import numpy as np
import pytest

from reelscope.llm import language

DROPPED = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.IGNORECASE | re.DOTALL)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b|http-equiv\s*=\s*[\"']?content-language[\"']?\s+content\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.IGNORECASE)


@pytest.mark.parametrize("page", ["<!--", "<script ", "<html ", "<", "<style></script>", "<!-- > ", "<html x", "a<b "])
def test_open_tags_take_linear_time(page):
    text = page * (5_000_000 // len(page))
    start = time.perf_counter()
    language.page_parts(text)
    assert time.perf_counter() - start < 3.0


def test_markup_is_dropped_as_the_patterns_say():
    rng = random.Random(1)
    pieces = ["<", ">", "<!--", "-->", "<script", "<SCRIPT>", "</script>", "<style>", "</style >", "<html", "<p>", " a ", "b\n", "-", "/"]
    for _ in range(5000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(15)))
        assert language.page_text(page) == DROPPED.sub(" ", page)


@pytest.mark.parametrize("page", [
    '<html lang="de"><p>x', "<HTML class=a lang = fr>", "<html><meta http-equiv='Content-Language' content='es'>", "<html lang=en><meta http-equiv=content-language content=de>",
    "<p lang=de>", "", None, "<html lang='x'>", "<html\nlang=ita>",
])
def test_declared_language(page):
    m = DECLARED.search(page or "")
    assert language.page_parts(page)[1] == ((m[1] or m[2]).lower() if m else "")


def posterior(rows, logs, model, pull=10.0):
    """The fused posterior of every (host, declared) row by plain loops over all rows."""
    k = len(model.languages)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    labels = [h.split(".") for h, _ in rows]
    keys = {"h": [h for h, _ in rows], "d": [".".join(x[-2:]) for x in labels], "s": [x[-1] for x in labels], "c": [c for _, c in rows]}
    overall = p.sum(axis=0) + 1.0
    overall = overall / overall.sum()
    out = []
    for i in range(len(rows)):
        own = {}
        for name, values in keys.items():
            total = np.zeros(k)
            for j in range(len(rows)):
                if values[j] == values[i]:
                    total += p[j]
            own[name] = np.maximum(total - p[i], 0.0)
        smooth = lambda c, wide: (c + pull * wide) / (c.sum() + pull)
        prior = smooth(own["h"], smooth(own["d"], overall))
        total = logs[i] + np.log(prior) + np.log(smooth(own["s"], overall) / overall) + np.log(smooth(own["c"], overall) / overall)
        e = np.exp(total - total.max())
        out.append(e / e.sum())
    return out


def test_posteriors_against_plain_loops(spark):
    rng = random.Random(4)
    words = {"en": "the thing that was there with them and then", "de": "der die das und nicht ein ich auf mich", "fr": "le les des une pour dans est que vous"}
    docs = spark.createDataFrame([(" ".join(rng.choices(w.split(), k=12)), lang) for lang, w in words.items() for _ in range(40)], "text string, lang string")
    model = language.fit_text_model(docs)
    assert model.languages == ["de", "en", "fr", language.BACKGROUND]
    hosts = ["a.x.de", "b.x.de", "www.y.com", "z.com", "q.fr", ""]
    pages = []
    for i in range(60):
        lang = rng.choice(list(words))
        said = rng.choice(["", lang, "en", "zz"])
        body = " ".join(rng.choices(words[lang].split(), k=rng.randrange(1, 5)))
        host = rng.choice(hosts)
        pages.append((i, f"http://{host}/p" if host else None, (f'<html lang="{said}">' if said else "") + body, host, said if said in ("", *words) else "other"))
    frame = spark.createDataFrame([(i, u, h, "clash", 1.0, 2) for i, u, h, _, _ in pages], "page_id long, url string, html string, found_lang string, h double, confidence int")
    logs = np.vstack([model.evidence([language.page_text(h)])[0] for _, _, h, _, _ in pages])
    want = posterior([(host, said) for _, _, _, host, said in pages], logs, model)
    for r in language.identify_pages(frame, model).collect():
        p = want[r.id]
        assert r.confidence == pytest.approx(p.max(), rel=1e-9)
        if r.accepted:
            assert r.found_lang == model.languages[int(p.argmax())]
        else:
            assert r.n_trigrams < 3 or p.max() < 0.5 or model.languages[int(p.argmax())] == language.BACKGROUND


def test_a_column_of_free_text_is_no_list_of_languages(spark):
    """10,000 values of lang: the model holds the most frequent ones only, and the fusion runs."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id < 10000 THEN 'en' ELSE concat('x', id % 10000) END AS lang", "concat('the other thing ', id) AS text", "'s' AS source")
    model = language.fit_text_model(docs, least_rows=1, most=8)
    assert len(model.languages) == 9 and "en" in model.languages
    assert language.accepted_documents(docs.limit(500), model).count() <= 500


def test_very_long_pages_nulls_and_empty_tables(spark):
    model = language.TextModel(["en", language.BACKGROUND], np.zeros((2, language.BUCKETS)))
    rows = [(1, "http://a.com/", "<html lang=en>" + "<script " * 100_000), (2, None, None), (None, "", ""), (3, "x", "<!--" * 100_000), (3, "x", "<!--" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert language.identify_pages(pages, model).count() == 5
    assert language.identify_pages(pages.limit(0), model).count() == 0
