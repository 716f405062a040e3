"""Stored feature grids, classifier rows, probability maps and reviewed-pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regionmatch.functions.scalars import sigmoid


def feature_grids(spark: SparkSession, path: str, scale: str | None = None) -> DataFrame:
    """Vectors per cell (image, scale, gh, gw, stride, gy, gx, vec), partitioned by scale."""
    g = spark.read.parquet(path)
    return g if scale is None else g.filter(F.col("scale") == scale)


def row_matrix(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Classifier rows of one split; the split is a partition, so others are never read."""
    return spark.read.parquet(path).filter(F.col("split") == split)


def probability_grids(spark: SparkSession, path: str, logits: bool = False) -> DataFrame:
    """Probability maps (query, gy, gx, p), turning stored logits into probabilities."""
    g = spark.read.parquet(path)
    return g.withColumn("p", sigmoid(F.col("p").cast("double"))) if logits else g.withColumn("p", F.col("p").cast("double"))


def domain_table(spark: SparkSession, path: str, build) -> DataFrame:
    """The reviewed-pixel table, built and written once.

    ``build(done)`` returns the pixels of the queries that ``done`` does not list yet.
    """
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:  # the table does not exist yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        build(None).write.parquet(path)
        return spark.read.parquet(path)
    build(stored.select("query").distinct()).write.mode("append").parquet(path)
    return spark.read.parquet(path)
