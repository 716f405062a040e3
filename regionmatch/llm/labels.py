"""Which rows may teach a model, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's digits modulo 3 is 1; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(labels: DataFrame, target: str, per_class: int | None = None, rows: int | None = None) -> list[tuple[int, int]]:
    """(doc_id, label) of a bounded sample of the rows that may teach: lowest hash first.

    ``per_class`` bounds each class, ``rows`` the whole sample. Ids with a null or contradicting
    label are left out.
    """
    clean = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
        .groupBy("doc_id").agg(F.min(target).alias("lo"), F.max(target).alias("hi"))
        .filter("lo = hi").select("doc_id", F.col("lo").cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    )
    if rows is not None:
        return [(r[0], r[1]) for r in clean.orderBy("h", "doc_id").limit(rows).collect()]
    out = []
    for y in (0, 1):
        out += [(r[0], r[1]) for r in clean.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class).collect()]
    return out


def only(docs: DataFrame, sample: list[tuple[int, int]]) -> DataFrame:
    """The documents of a bounded sample with their label ``y``; the ids are broadcast, being bounded."""
    spark = docs.sparkSession
    ids = spark.createDataFrame(sample, "doc_id long, y int")
    return docs.join(F.broadcast(ids), "doc_id")
