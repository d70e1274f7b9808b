"""Corpus pipeline: language, quality, near copies, benchmark passages, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and hands the re-read table to the next one.
All stages but the last return the columns of ``docs``:

* ``language_id`` drops documents that the nearest-centroid model rejects;
* ``quality`` drops documents that the co-trained classifier rejects;
* ``near_dedup`` keeps one document of each near-duplicate component, the one
  with the smallest id (of repeated rows, one);
* ``decontaminate`` drops documents that hold a benchmark item;
* ``tokenize`` encodes the rest: doc_id, n_tokens, ids_sha256, decoded_sha256, intact, token_ids.

Empty input gives empty output of the same schema. Null ids are kept as documents
of their own; nulls in other columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import bpe, decontaminate, language_id, near_dedup, quality
from barspark.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    return language_id.predict(docs, model, names=NEW).where(~F.col(NEW[2])).select(*_columns(docs))


def rate_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, names=NEW[1:]).where(F.col(NEW[2])).select(*_columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, tokens=True)


#: Verdict columns inside a stage; names that no table has.
NEW = ("_stage_label", "_stage_score", "_stage_verdict")

STAGES = [
    ("language_id", identify_language),
    ("quality", rate_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("tokenize", tokenize),
]

#: No stage but the third can be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
