"""Registered queries of the text operators: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelink.llm import (decontamination, html_extract, jaccard_join, language_id, nearest, packing, prefix_trie, quality,
                          simhash, toxicity, url_templates, web_archive, whitening)
from tidelink.llm.common import in_fold, read_docs


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge_urls(read_docs(spark, sf_dir, "pages"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_docs(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read_docs(spark, sf_dir), read_docs(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    model = language_id.train(docs, ~in_fold("doc_id", 3, 1))
    found = language_id.predict(docs, model)
    return found.select("doc_id", in_fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_docs(spark, sf_dir))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read_docs(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_docs(spark, sf_dir))


def op8_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = web_archive.round_trip(read_docs(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_docs(spark, sf_dir), read_docs(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_docs(spark, sf_dir), read_docs(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_docs(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_docs(spark, sf_dir, "embeddings"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_templates": op1_url_templates,
    "op2_html_extract": op2_html_extract,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_packing": op5_packing,
    "op6_nearest": op6_nearest,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_web_archive": op8_web_archive,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_simhash": op13_simhash,
}
#: 160 bits of a SHA-1 in hexadecimal, five at a time, as base32 digits.
_BASE32 = """list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    (instr('0123456789abcdef', substr(hex, (5 * i // 4 + 1)::INTEGER, 1)) - 1) * 16
    + greatest(instr('0123456789abcdef', substr(hex || '0', (5 * i // 4 + 2)::INTEGER, 1)) - 1, 0))
    >> (3 - 5 * i % 4)::INTEGER) & 31)::INTEGER, 1)), lambda a, b: a || b)"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_templates": url_templates.oracle_sql(),
    "op8_web_archive": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m""",
    "op11_prefix_trie": prefix_trie.oracle_sql(),
}
