"""The queries of the library proper, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import allocation, audits, delivery, evaluation, files, frame_grids, logs, publishing, quality, storage, streams  # noqa: F401
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["quality_corpus_report"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
