"""The named queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelscope.llm import chat, jaccard, language, neighbours, pieces, quality, ranked, simhash, simple8b, toxicity, warc, whitening, winnow
from reelscope.llm.common import staged, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    found = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(found.origin), name) if found else os.path.join("/opt/tokenizers", name)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; every fifth id by hash is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out("doc_id", 5, 0))
    scored = model.score(docs.select("doc_id", "text"), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; every fourth id by hash is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~toxicity.held_out("doc_id", 4, 2))
    scored = model.score(docs.select("doc_id", "text"), keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    folder, manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    rows = warc.read_archives(spark, folder, manifest, payloads=False)
    return rows.select(F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


ORACLE["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY sha1(h), octet_length(encode(h))) AS top FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(x, (5 * (i // 4) + 1)::BIGINT, 5))::INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d"""


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the text model is fitted on documents with a language."""
    model = language.fit_text_model(table(spark, sf_dir, "documents"))
    return language.identify_pages(table(spark, sf_dir, "pages"), model).withColumnRenamed("id", "page_id")


@query
def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written in Simple-8b files in order of doc_id and read back."""
    docs = table(spark, sf_dir, "documents")
    encoder = simple8b.tokenizer_ids(tokenizer_file("word_bpe_49k.json"), end_id=2)
    folder, manifest = simple8b.write_tokens(docs, encoder)
    return simple8b.read_tokens(folder, manifest).withColumnRenamed("id", "doc_id")


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in ten words running of a benchmark item."""
    sizes, spans = winnow.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    found = winnow.report(sizes, spans)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op6_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
dg AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dg.m, item_id FROM dg JOIN win USING (m, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that holds control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    tricky = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digest(staged(chat.formatted(rows.unionByName(tricky)), "chat"))


ORACLE["op7_chat"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum(n + 23)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest document it is linked with, directly or not."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best segmentation, the scores of its four best, and whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = ("n_tokens", "ids_crc32", "score", "nbest_scores", "nbest_ids_crc32", "round_trip")
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), n=4, parts=parts, keep=["doc_id"])


@query
def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    found = neighbours.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
    return found.select(F.col("query_id").cast("bigint"), "rank", F.col("vec_id").cast("bigint"), "score")


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on up to 32 components of the covariance, scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=32).withColumnRenamed("id", "vec_id")


@query
def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10).withColumnRenamed("id", "doc_id")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op12_ranked"] = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
df AS (SELECT term, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, c GROUP BY term, c.n),
m AS (SELECT doc_id, 10 + (90 * len(w) * c.n) // c.l AS m FROM d, c WHERE len(w) > 0),
scores AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query
def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the smallest document it is linked with, directly or not."""
    found = jaccard.near_copies(table(spark, sf_dir, "documents"), words=4, share=(85, 100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


ORACLE["op13_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
named AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS node, s FROM s),
t AS (SELECT node, n, unnest(s) AS token FROM named WHERE node = doc_id),
links AS (SELECT a.node AS u, b.node AS v FROM t a JOIN t b ON a.token = b.token AND a.node < b.node
          GROUP BY a.node, b.node HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT DISTINCT node, node AS other FROM named UNION SELECT reach.node, edges.v FROM reach JOIN edges ON reach.other = edges.u),
roots AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM named JOIN roots USING (node)"""
