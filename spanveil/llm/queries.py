"""One query per training-data operator, with production parameters over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, language_id, line_dedup, ngram_join, packing, quality, sharding, url_filter, warc
from .common import held_out, table


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_url_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, ["page_id"])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), n=4, near=85, of=100)


def op3_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language_id.fit(docs.where(~held_out(F.col("doc_id"))), F.col("lang"), F.col("text"))
    return language_id.predict(docs, profiles, F.col("text"), [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op6_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    carry = {"size": (F.length(text) + 16).cast("long"), "text_crc32": F.crc32(text)}
    dealt = sharding.assign(table(spark, sf_dir, "documents"), 40, carry=carry)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit(table(spark, sf_dir, "documents"))


def op9_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source: the cleaned text, its lines, and those cut."""
    cleaned = line_dedup.clean(table(spark, sf_dir, "documents"), F.col("source"))
    return cleaned.select("doc_id", "source", "text", F.col("line_dedup.n_lines").cast("long").alias("n_lines"), F.col("line_dedup.n_cut").cast("long").alias("n_cut"))


def op10_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = quality.train(docs, labels)
    scored = quality.score(docs, model, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")], F.col("text"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {f.__name__: f for f in (op1_url_filter_cascade, op2_ngram_jaccard_join, op3_language_profiles, op4_zip_warc, op5_best_fit_packing, op6_stratified_sharding, op7_benchmark_decontamination, op8_bottom_k_fingerprints, op9_site_line_dedup, op10_additive_quality)}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filter_cascade": """
        WITH rules(verdict, rule, h, p) AS (VALUES
            ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
            ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
        rest AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (SELECT k, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest),
        fits AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
                 FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (k)
    """,
    "op4_zip_warc": """
        WITH d AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        o AS (SELECT t, max(page_id) AS owner FROM d GROUP BY t),
        v AS (SELECT page_id, strlen(d.t) AS n, h, nullif(owner, page_id) AS refers_to FROM d JOIN o ON d.t = o.t),
        bits AS (SELECT *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + ((('0x' || substr(h, 1 + (i * 5) // 4, 2))::INT >> (3 - (i * 5) % 4)::INT) & 31)::INT, 1)) AS c FROM v)
        SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(c, '') AS payload_digest,
               CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM bits
    """,
    "op9_site_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
        each_line AS (SELECT DISTINCT k, source, trim(l, ' ' || chr(9) || chr(13)) AS line FROM (SELECT k, source, unnest(lines) AS l FROM d)),
        pages AS (SELECT source, count(*) AS n FROM d GROUP BY source),
        bad AS (
            SELECT e.source, e.line FROM each_line e JOIN pages p ON e.source IS NOT DISTINCT FROM p.source
            WHERE e.line <> '' GROUP BY e.source, e.line, p.n HAVING count(*) >= {line_dedup.LEAST_PAGES} AND count(*) > {line_dedup.RATIO}::DOUBLE * p.n
        ),
        bad_of AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
        kept AS (
            SELECT d.doc_id, d.source, d.text, d.lines,
                   CASE WHEN b.bad IS NULL THEN d.lines ELSE list_filter(d.lines, lambda l: NOT list_contains(b.bad, trim(l, ' ' || chr(9) || chr(13)))) END AS kept
            FROM d LEFT JOIN bad_of b ON d.source IS NOT DISTINCT FROM b.source
        )
        SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
               coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_cut
        FROM kept
    """,
}
