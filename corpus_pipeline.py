"""Corpus pipeline: quality rules, line dedup, near-dedup, source mix, byte-level BPE. Each stage is one operator of quarryline.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet in the shared folder and read again as the next
one's docs. All but the last return the columns of documents:

quality_rules   drops the documents that the rules or the trees reject; labels come from sf_dir
line_dedup      removes repeated runs of lines from the texts; every row stays
near_dedup      keeps one document of each class of near copies; texts left empty by line dedup are equal, so of one class
source_mix      returns the mix in training order: a row for each copy taken, so a document comes up to twice or not at all
byte_bpe        returns doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes for every row of the mix

A stage's result is written before the next stage begins, so each stage first frees the working tables of those before it.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import _shared, bpe, curriculum, line_chunks, near_dups, quality


_OWNER = "pipeline"


def _stage(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _shared.free(spark, _OWNER)
        with _shared.owned(_OWNER):
            return stage(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(docs, line_chunks.Runs())


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.near_dedup(docs)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mixed(docs)


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, *bpe.default_vocabulary())


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: SQL can't express trees trained here, content-defined chunks, near copies or BPE. Tests hold single operators against brute force; the pipeline's stages on their own inputs are checked for columns and row counts alone.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, own, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), uuid.uuid4().hex, ""
    for name, stage in STAGES[:-1]:
        with _shared.owned(f"{own}-{name}"):
            docs = _shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            _shared.free(spark, before)
        before = f"{own}-{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
