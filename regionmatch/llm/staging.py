"""Steps written to the shared folder, whose shuffle files go as soon as they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from regionmatch.session import scratch_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared folder; it survives lost executors.

    While it is written, Spark is told to drop the step's shuffle files at its end, so that a chain of
    steps holds the files of one step only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or the first of name_1, name_2 and so on that is not taken (in any case of letters)."""
    used, k, found = {c.lower() for c in taken}, 0, name
    while found.lower() in used:
        k += 1
        found = f"{name}_{k}"
    return found
