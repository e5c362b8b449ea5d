"""All queries of the drift engine with the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answers, detection, files, localisation, modelling, profiling, relational, scoring, streams, tooling, trials  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices of the retail panel whose sales distribution moved most."""
    return QUERIES["k10_within_slice_topk"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
