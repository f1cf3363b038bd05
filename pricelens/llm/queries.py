"""The registered queries of the operators and, where SQL can say it, the SQL they are compared with."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import decontaminate, exact_dedup, fill_middle, licenses, maxent_lm, mixing, ngram_join, quality, spelling, suffix_dedup, toxicity, url_filter, warc
from pricelens.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).orderBy("position", "doc_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.round_trips(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_suffix_dedup, op3_toxicity, op4_exact_dedup, op5_mixing, op6_license_scan, op7_warc, op8_lm_scores, op9_ngram_jaccard_join, op10_decontamination,
                                    op11_quality, op12_fill_in_middle, op13_spelling_variants)}

#: SHA-1 in base32, from the hex digits: four bits of each, then five for each letter.
BASE32 = """array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([CASE WHEN substr(bits, 5 * i + k + 1, 1) = '1' THEN 1 << (4 - k) ELSE 0 END
            for k in range(0, 5)])::BIGINT, 1) for i in range(0, 32)], '')"""

ORACLE = {
    "op7_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS first,
                     array_to_string([substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * instr('0123456789abcdef', c) - 3, 4) for c in string_split(sha1(html), '')], '') AS bits FROM p)
        SELECT page_id, n AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        g AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                                ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
        FROM f""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM s),
        w AS (SELECT *, [5, 2, 1][(rn - 1) % 3 + 1]::BIGINT AS w, [0.5, 0.0, -0.5][(rn - 1) % 3 + 1]::DOUBLE AS slope, sum(source_size) OVER () AS total FROM r),
        h AS (SELECT *, 3 * source_size * sum(w) OVER (ORDER BY source_size / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                        <= w * (total - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS held FROM w),
        t AS (SELECT *, CASE WHEN held THEN (3 * source_size)::DOUBLE
                        ELSE (w * (total - sum(CASE WHEN held THEN 3 * source_size ELSE 0 END) OVER ()))::DOUBLE / sum(CASE WHEN held THEN 0 ELSE w END) OVER () END AS target FROM h),
        p AS (SELECT d.doc_id, d.size, t.source_size::BIGINT AS source_size, t.target, t.slope,
                     (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before,
                     CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS full_passes
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        q AS (SELECT *, least(full_passes + CASE WHEN before + size / 2.0::DOUBLE <= target - full_passes * source_size THEN 1 ELSE 0 END, 3)::BIGINT AS passes,
                     least(before / nullif(target, 0), 1.0) AS y FROM p)
        SELECT doc_id, size, source_size, target, (size * passes)::BIGINT AS taken,
               round(CASE WHEN size * passes = 0 THEN NULL WHEN y <= 0 THEN 0.0 ELSE 2.0 * y / ((1.0 - slope) + sqrt((1.0 - slope) * (1.0 - slope) + 4.0 * slope * y)) END, 9) AS position
        FROM q""",
}
