"""Queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.plans import detection, ledger, release, texts

MODULES = [detection, texts, ledger, release]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.classified_by_language(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
