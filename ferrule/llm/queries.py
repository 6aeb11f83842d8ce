"""The queries of the training-data operators: thin contracts over the operators' own results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import bpe, decontaminate, licenses, media, ngram_join, token_files, toxicity, url_filter, warc, wordpiece
from ferrule.llm.common import read_table, scratch_dir, spread, trim_executors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    trim_executors(spark)
    back = bpe.encode(docs, keep_text=False, decoded="decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.new_folder(spark)
    token_files.write(_documents(spark, sf_dir), out)
    return token_files.read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return wordpiece.token_counts(docs).select("doc_id", "n_words", "n_tokens")


@_query
def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "media")
    media.store(_documents(spark, sf_dir), out)
    manifest, whole = media.read(spark, out)
    seen = whole.select(
        "medium", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature"
    )
    return manifest.join(seen, "medium", "left").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


#: The rules of the URL filter's contract.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@_query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op2_url_rules"] = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
split AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                        WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                        WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM fits
"""


@_query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.new_folder(spark)
    warc.write(read_table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_documents(spark, sf_dir), k=4, num=85, den=100)


@_query
def op4_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, bench).select("doc_id", "item_id", "coverage", F.col("matched").alias("matched_tokens"), F.col("n_tiles").cast("long").alias("n_tiles"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.crc_fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op3_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "line", "license", "reduction", F.size("differences").cast("long").alias("n_differences"))


ORACLE_SQL["op10_warc_revisits"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1)), 'string_agg', '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
"""
