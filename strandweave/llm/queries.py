"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import html_extract, iblt, language_id, license_scan, line_dedup, media, mixing, packing, simhash, substring_dedup


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


def tokenizer_path() -> str:
    """The public tokenizer that the packing queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path(), 1024, 2)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(_documents(spark, sf_dir), 35, with_text=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_versions(_documents(spark, sf_dir))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_documents(spark, sf_dir))


# The columns of three results that SQL can say; each runs the whole operator.


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def document_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_html_extraction": op9_html_extraction,
    "op10_media_columns": op10_media_columns,
    "mixing_targets": mixing_targets,
    "document_edits": document_edits,
    "media_payloads": media_payloads,
}

#: The others need hashes, tokenizers, sketches or fits that SQL lacks; the tests hold them against brute force.
SQL: dict[str, str] = {
    "op4_line_dedup": r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS t FROM documents),
w AS (SELECT doc_id, line, t, doc_id * 1000000 + line AS o, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a FROM l), z AS (SELECT *, array_to_string(a, ' ') AS s FROM w),
f AS (SELECT s, any_value(a) AS a, min(o) AS o FROM z WHERE len(a) > 0 GROUP BY s), b AS (SELECT s, md5(s) AS h, o FROM f WHERE len(a) >= 5),
v AS (SELECT s, o, len(a) AS n, i, md5(array_to_string(list_concat(a[1:i - 1], a[i + 1:]), ' ')) AS h FROM (SELECT s, a, o, unnest(generate_series(1, len(a))) AS i FROM f WHERE len(a) >= 5)),
g AS (SELECT n, i, h, min(o) AS o FROM v GROUP BY n, i, h), near AS (SELECT v.s FROM v JOIN g ON v.n = g.n AND v.i = g.i AND v.h = g.h AND g.o < v.o
UNION SELECT v.s FROM v JOIN b ON v.h = b.h AND b.o < v.o UNION SELECT b.s FROM v JOIN b ON v.h = b.h AND v.o < b.o),
r AS (SELECT z.doc_id, z.line, z.t, f.s IS NOT NULL AND (z.o > f.o OR near.s IS NOT NULL) AS gone FROM z LEFT JOIN f ON z.s = f.s LEFT JOIN near ON z.s = near.s),
k AS (SELECT doc_id, count(*) AS n_lines, coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT doc_id, n_lines, CASE WHEN kept = '' THEN 0 ELSE length(kept) - length(replace(kept, chr(10), '')) + 1 END AS n_kept, sha256(kept) AS kept_sha256 FROM k""",
    "op6_substring_dedup": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
x AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER f = 35 THEN md5(string_agg(word, ' ') OVER f) END AS h FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
d AS (SELECT h FROM x WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1), r AS (SELECT x.*, d.h IS NOT NULL AS again FROM x LEFT JOIN d ON x.h = d.h),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS t FROM c GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id""",
    "mixing_targets": r"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
g AS (SELECT 1.5 * sum(size)::DOUBLE AS total FROM s), lvl AS (SELECT 0 AS step, total / (SELECT sum(w) FROM s) AS level FROM g
UNION ALL SELECT step + 1, (SELECT (any_value(total) - coalesce(sum(2.0 * size) FILTER (WHERE lvl.level * w > 2.0 * size), 0)) / sum(w) FILTER (WHERE lvl.level * w <= 2.0 * size) FROM s, g) FROM lvl WHERE step < 60)
SELECT doc_id, d.size, s.size AS source_size, round(least(2.0 * s.size, coalesce((SELECT max(level) FROM lvl WHERE step = 60), 1e300) * w), 6) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source""",
    "document_edits": r"""WITH o AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC NULLS LAST) AS r, count(*) OVER () AS c FROM documents)
SELECT a.doc_id, a.n AS n_chars, sha256(left(a.t, a.n - a.n // 3) || left(b.t, a.n // 3)) AS edited_sha256 FROM o a JOIN o b ON b.r = a.r % a.c + 1""",
    "media_payloads": r"""WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), q AS (SELECT *, greatest(576, (octet_length(b) + 575) // 576 * 576) AS n FROM p),
r AS (SELECT doc_id, octet_length(b) AS n_bytes, n, unhex(hex(b) || repeat('FF', n - octet_length(b))) AS body FROM q), m AS (SELECT *, encode('P5' || chr(10) || '576 ' || (n // 576) || chr(10) || '255' || chr(10)) || body AS media FROM r)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(body) AS payload_sha256, octet_length(media) AS media_bytes, sha256(media) AS media_sha256 FROM m""",
}
