"""Queries of the general data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketweave.operators.timestamp_mixture import article_instants
from marketweave.session import spread

ARTICLES = "batch_1789375807_210"


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_instants(spread(spark.read.parquet(f"{sf_dir}/{ARTICLES}.parquet")), spark.read.parquet(f"{sf_dir}/sites.parquet"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir).filter("utc_us is not null").select("seq", "field", "utc_us")


def p3_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its status, so that unresolved ambiguity shows."""
    return _instants(spark, sf_dir).select("seq", "field", "utc_us", "reading_status", "reading_posterior")


QUERIES = {f.__name__: f for f in (p3_found, p3_readings)}
SQL: dict[str, str] = {}
