"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import kept_folder
from ..streaming import incremental
from .views import SQL

QUERIES, ORACLES = {}, {}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").load(sf_dir)
    return lines.select(F.col("l_linestatus").alias("sample"), F.col("l_suppkey").alias("id"), F.expr("cast((dayofyear(l_shipdate) - 1) div 7 as int)").alias("pos"), (F.col("l_returnflag") == "R").cast("bigint").alias("hit"))


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as a stream of one batch, counted in complete mode; the table of counts goes when the driver ends."""
    return incremental.last_counts(_cells(spark, sf_dir), kept_folder(spark))


QUERIES["k03_streamed_counts"] = streamed_counts
ORACLES["k03_streamed_counts"] = f"with {SQL['rc']} select sample, id, pos, count, coverage from rc"
