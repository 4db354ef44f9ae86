"""Queries of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.token_counts import count_document_tokens

    return count_document_tokens(table(spark, sf_dir, "documents"))


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.html_blocks import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op3_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.toxicity_neighbours import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.decontamination import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.bagminhash import find_near_duplicates

    return find_near_duplicates(table(spark, sf_dir, "documents"))


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.subword_quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii_labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.pii_labelers import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.license_index import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.bpe_chunks import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.llm.quality_rules import apply_quality_rules

    return apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_html_blocks, op3_toxicity_neighbours, op4_decontamination, op5_bagminhash, op6_subword_quality, op7_pii_labelers, op8_license_index, op9_bpe_chunks, op10_quality_rules)}


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP4 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS x FROM (SELECT id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') AS x FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win))),
hit AS (SELECT DISTINCT rid, k, s, id FROM dw JOIN win USING (k, x)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + k)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""


def oracle_sql() -> dict[str, str]:
    """SQL where a whole result can be told in it; the other queries rest on trained models, tokenizers or parsers."""
    return {"op4_decontamination": _OP4}
