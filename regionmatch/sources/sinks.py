"""Sinks: mask runs, reports, label-free requests, incremental and append-only results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionmatch.operators.contracts import REQUEST_FIELDS


def label_free(manifest: DataFrame) -> DataFrame:
    """Only the public request fields; labels never leave the manifest."""
    return manifest.select(*[c for c in REQUEST_FIELDS if c in manifest.columns])


def write_requests(manifest: DataFrame, path: str) -> None:
    """JSON lines; absent optional fields are left out rather than written as null."""
    label_free(manifest).write.option("ignoreNullFields", "true").json(path)


def write_masks(runs: DataFrame, path: str) -> None:
    """Mask runs partitioned by query; the committer makes each write all-or-nothing."""
    runs.select("query", "y", "x0", "x1").write.partitionBy("query").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON record with sorted keys; undefined metrics stay visible as null."""
    bad = None
    for name, kind in report.dtypes:
        if kind == "double":
            nan = F.count_if(F.isnan(name) | (F.abs(name) == float("inf")))
            bad = nan if bad is None else bad + nan
    if bad is not None and report.agg(bad.alias("n")).first()["n"]:
        raise ValueError("a report holds no NaN or infinite metric")
    report.select(*sorted(report.columns)).coalesce(1).write.option("ignoreNullFields", "false").json(path)


def write_probabilities(prob: DataFrame, path: str, digits: int | None = None) -> None:
    """Probability grid at reduced precision."""
    p = F.round("p", digits) if digits is not None else F.col("p")
    prob.withColumn("p", p.cast("float")).write.parquet(path)


def not_yet_written(todo: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Items of ``todo`` that the output does not hold yet."""
    return todo.join(written.select(key), key, "left_anti")


def append_result(result: DataFrame, path: str) -> None:
    result.write.mode("append").json(path)
