"""Queries over this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import bpe, curriculum, licenses, line_chunks, media_archive, near_dups, quality, secrets_lex, url_vocab, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_near_dedup": near_dups.op2_near_dedup,
        "op3_line_dedup": line_chunks.op3_line_dedup,
        "op4_url_filters": url_vocab.op4_url_filters,
        "op5_source_mix": curriculum.op5_source_mix,
        "op6_media_columns": media_archive.op6_media_columns,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_secret_scan": secrets_lex.op8_secret_scan,
        "op9_warc": warc.op9_warc,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": url_vocab.OP4_SQL, "op5_source_mix": curriculum.OP5_SQL, "op9_warc": warc.OP9_SQL}
