"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, licenses, line_dedup, media, quality, secrets, url_filter, warc
from tessera.llm.common import read_table, scratch_path

RANKS = "byte_bpe_multi_50k.tiktoken"
RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def _joined_spans(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined_spans("base"), 256).alias("base_sha256"), _joined_spans("spans").alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    digest = lambda c: c.select("file", "at", "next", F.col("kind").alias("record_type"), F.expr("try_cast(id AS BIGINT)").alias("page_id"), F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"), "declared_digest", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    records = warc.read_archives(spark, path, digest)
    whole = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    # A revisit's payload is its response's: one row for each that is referred to.
    referred = whole.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "declared_digest"])
    again = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "declared_digest").join(referred, ["refers_to", "declared_digest"], "left")
    return whole.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, depths = url_filter.rule_table(spark, RULES)
    judged = url_filter.filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), rules, depths)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_to_media(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = media.fingerprint(stored)
    codes = F.sha2(F.col("fingerprint").cast("string"), 256)
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint").cast("string"), codes).alias("feature"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), columns=["doc_id", "source", "lang"])
    return judged.select("doc_id", "source", "lang", "evidence", "host_rate", "path_rate", "p_good", "keep")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    ids = bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, bpe.token_table(spark, path)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc": op3_warc,
    "op4_url_filter": op4_url_filter,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_media": op6_media,
    "op7_license_scan": op7_license_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        w AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to
        FROM w""",
    "op4_url_filter": f"""
        WITH u AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {_UPPER}) AS host,
                 regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
        r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (
          SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(rverdict, length(rhost || rpath)) AS rverdict
          FROM u LEFT JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
          GROUP BY page_id, host, path)
        SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m""",
    "op8_line_dedup": f"""
        WITH l AS (SELECT doc_id, generate_subscripts(lines, 1) AS n, unnest(lines) AS line
                   FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
        k AS (SELECT *, translate(trim(line, {_WHITE}), {_UPPER}) AS key FROM l),
        f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id""",
}
