"""Checks of files and counts against published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_problems(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected, or differ in size or SHA-256.  ``expected``: name, bytes, sha256."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    got = f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("_bytes"), F.sha2("content", 256).alias("_sha"))
    j = expected.join(got, "name", "full")
    rule = (F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected")
            .when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_sha") != F.lower("sha256"), "checksum"))
    return j.select("name", rule.alias("rule")).filter("rule is not null")


def count_mismatches(actual: DataFrame, expected: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Expected pixel totals that the recomputed ones do not meet; an absent key counts as zero."""
    got = actual.select(key, *[F.col(c).alias(f"got_{c}") for c in columns])
    j = expected.join(got, key, "left").fillna(0, [f"got_{c}" for c in columns])
    off = F.lit(False)
    for c in columns:
        off = off | (F.col(c) != F.col(f"got_{c}"))
    return j.filter(off)
