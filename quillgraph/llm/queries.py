"""The opN_<name> queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, fingerprint, html, kneserney, langid, leaderboard, licenses, mixing, neardup, packing, quality, repair, urlfilter
from quillgraph.llm.common import table

OP4_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(*OP4_COLUMNS)


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.modelled(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_leaderboard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.feed(*[table(spark, sf_dir, t) for t in ("sale_lines", "items", "vendors")])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.reported(rows, repair.damaged(rows))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_packing": op2_packing,
        "op3_url_filter": op3_url_filter,
        "op4_quality_rules": op4_quality_rules,
        "op5_lm_scores": op5_lm_scores,
        "op6_bpe": op6_bpe,
        "op7_near_duplicates": op7_near_duplicates,
        "op8_fingerprints": op8_fingerprints,
        "op9_language_id": op9_language_id,
        "op10_license_scan": op10_license_scan,
        "op11_source_mixing": op11_source_mixing,
        "op12_leaderboard_feed": op12_leaderboard_feed,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": urlfilter.sql(),
        "op4_quality_rules": quality.SQL,
        "op10_license_scan": licenses.sql(),
        "op11_source_mixing": mixing.SQL,
        "op12_leaderboard_feed": leaderboard.SQL,
    }
