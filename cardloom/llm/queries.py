"""Registered queries of the corpus operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import ann, conversation_queries, decontamination, html_text, ngram_join, packing, pii, quality, token_files, toxicity, warc

#: ASCII lower case only, then the words of a text, in DuckDB.
_SQL_WORDS = r"""regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The session's setting with the key of surrogates; Spark hides settings called so in its logs and pages.
KEY_SETTING = "spark.cardloom.secret.key"


def surrogate_key(spark: SparkSession) -> str:
    """The session's key; where it names none, one that everybody knows, for tables of made-up persons only."""
    return spark.conf.get(KEY_SETTING, None) or "change this key for every corpus"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with keyed surrogates for its personal data."""
    replaced = pii.replace_entities(_table(spark, sf_dir, "documents"), key=surrogate_key(spark))
    return replaced.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"), "n_entities", F.array_join("entity_kinds", ",").alias("entity_kinds"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of every fifth id, by checksum, are never learned."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id", 5, 0)))
    return toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of every fourth id, by checksum, are never learned."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~toxicity.held_out("doc_id", 4, 2)))
    return quality.score_quality(docs, model).select("doc_id", toxicity.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary=vocabulary("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to shards and read back through their indexes."""
    folder = token_files.write_tokens(_table(spark, sf_dir, "documents"), vocabulary=vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document: five-word shingles, similarity 0.8 or more."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back."""
    records = warc.read_warc(spark, warc.write_warc(_table(spark, sf_dir, "pages"))).where("problem IS NULL")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, by inner product."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents contain benchmark windows, and how much of each."""
    found = decontamination.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.report(found)


_OP10 = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_SQL_WORDS.format("text")} AS w FROM benchmark)),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b WHERE n > 0)),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
o AS (SELECT x.doc_id, x.n, x.i, p.item_id FROM x JOIN p ON x.n = p.n AND x.s = p.s),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


_OP4 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""

_OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, w, least(5, len(w)) AS n FROM (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM documents)),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d WHERE n > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN c x ON x.doc_id = p.a JOIN c y ON y.doc_id = p.b WHERE 5 * common >= 4 * (x.n + y.n - common)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
k AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT r.doc_id, min(r.other) AS class_id, any_value(coalesce(n_links, 0)) AS n_links FROM r LEFT JOIN k ON k.doc_id = r.doc_id GROUP BY r.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_surrogates": op1_surrogates,
        "op2_toxicity": op2_toxicity,
        "op3_quality": op3_quality,
        "op4_warc": op4_warc,
        "op5_nearest": op5_nearest,
        "op6_packing": op6_packing,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_token_files": op8_token_files,
        "op9_html_text": op9_html_text,
        "op10_decontamination": op10_decontamination,
        **conversation_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": _OP4,
        "op7_ngram_jaccard": _OP7,
        "op10_decontamination": _OP10,
        **conversation_queries.oracle_sql(),
    }
