"""Names of the registered queries, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from predial.plans import listing_queries, model_queries, more_queries, other_queries, survey_queries


def queries() -> dict:
    return listing_queries.QUERIES | other_queries.QUERIES | more_queries.QUERIES | survey_queries.QUERIES | model_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return listing_queries.SQL | other_queries.SQL | more_queries.SQL | survey_queries.SQL | model_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicate, filter, price by zone, flag and count the funnel."""
    return listing_queries.funnel(spark, sf_dir)
