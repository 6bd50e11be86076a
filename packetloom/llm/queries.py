"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import fingerprints, packing, quality, sharding, simhash, substring, toxicity, unigram, urls
from packetloom.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.repeated_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))  # without an id: never trained on
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = sharding.shuffle_into_shards(docs)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    return dealt.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs).select("doc_id", *quality.BASE, "kept", "n_lines", "n_bad_lines", "lost_chars")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.count_tokens(docs, unigram.rank_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = unigram.encode_texts(docs, unigram.rank_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), unigram.ids_digest().alias("ids_crc32"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filters": op2_url_filters,
    "op3_toxicity": op3_toxicity,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_sharding": op5_sharding,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
}


def _url_sql() -> str:
    cases = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for v, h, p in cases]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " END"
    return f"""
    WITH cutup AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{urls.UPPER}', '{urls.LOWER}') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
    named AS (SELECT *, regexp_replace(host, '^(www|m|blog)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') AS canonical FROM cutup),
    listed AS (SELECT canonical FROM named WHERE canonical <> '' GROUP BY canonical HAVING count(*) >= 2)
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict, canonical FROM named"""


ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": _url_sql(),
    "op7_quality_rules": quality.quality_sql(),
}
