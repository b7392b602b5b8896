"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import language, masked_lm, url_filter
from lakeloom.llm.common import held_out
from lakeloom.llm.decontaminate import search_benchmark
from lakeloom.llm.embedding_dedup import near_vectors
from lakeloom.llm.mixing import mix
from lakeloom.llm.simhash import near_duplicates
from lakeloom.llm.token_store import token_table
from lakeloom.llm.toxicity import score, train
from lakeloom.llm.warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return masked_lm.score(docs, masked_lm.train(docs), by_word=True).drop("text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = search_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(url_filter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def vocabulary() -> str:
    """The tokenizer file of the contract; it lies at the same path on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), vocabulary())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = held_out(F.col("doc_id"))
    model = language.train(docs.where(~fold))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (op1_masked_lm, op2_warc, op3_toxicity, op4_decontaminate, op5_simhash, op6_url_filter, op7_token_ids, op8_language, op9_embedding_dedup, op10_mixing)
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Equivalent SQL, where learning, hashing or chance don't rule it out.
ORACLE: dict[str, str] = {
    "op2_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
                   ((strpos('0123456789abcdef', substr(p.h, 1 + (5 * i) // 4, 1)) - 1) * 16
                    + greatest(strpos('0123456789abcdef', nullif(substr(p.h, 2 + (5 * i) // 4, 1), '')), 1) - 1)
                   >> (3 - (5 * i) % 4)) & 31), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM p JOIN f USING (h)""",
    "op4_decontaminate": f"""
        WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, w[k:k + least(len(w), 10) - 1] AS g, least(len(w), 10) AS n
                FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM iw WHERE len(w) > 0)),
        dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        grams AS (SELECT doc_id, w[k:k + n - 1] AS g, k, n
                  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        occ AS (SELECT doc_id, item, k, grams.n FROM grams JOIN win ON grams.g = win.g),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM occ) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
}
