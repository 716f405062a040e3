"""Raster files through Spark's own ``image`` and ``binaryFile`` sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from regionmatch.operators.contracts import bad_encodings

# Fixed values of the PNG header: signature, and byte positions (from one) of its fields.
PNG_SIGNATURE = "89504E470D0A1A0A"
GRAY = 0


def _number(c: Column, start: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(c, start, length)), 16, 10).cast("int")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """Size, bit depth and colour type of PNG files, read from the first bytes only kept as columns."""
    f = spark.read.format("binaryFile").load(path)
    b = F.col("content")
    return f.select(
        "path", F.col("length").alias("bytes"), (F.hex(F.substring(b, 1, 8)) == PNG_SIGNATURE).alias("is_png"),
        _number(b, 17, 4).alias("width"), _number(b, 21, 4).alias("height"),
        _number(b, 25, 1).alias("depth"), _number(b, 26, 1).alias("colour"))


def header_problems(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Masks that are missing, not gray PNGs, or not of the declared size.

    ``expected``: path, width, height.  The join keeps every expected file, so a missing one
    is a problem and never a dropped row.
    """
    h = files.select("path", "is_png", F.col("width").alias("_w"), F.col("height").alias("_h"), "depth", "colour")
    j = expected.join(h, "path", "left")
    c = F.col
    rule = (
        F.when(c("is_png").isNull(), "missing").when(~c("is_png") | (c("colour") != GRAY) | ~c("depth").isin(1, 8), "bad_encoding")
        .when((c("_w") != c("width")) | (c("_h") != c("height")), "wrong_shape"))
    return j.select("path", rule.alias("rule")).filter("rule is not null")


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """One row per raster line: path, h, w, y and the gray bytes of the line."""
    i = spark.read.format("image").load(path).select("image.*")
    i = i.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("n"), "data")
    rows = i.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    line = F.substring(F.col("data"), F.col("y") * F.col("w") * F.col("n") + 1, F.col("w") * F.col("n"))
    return rows.select("path", "h", "w", "y", "n", line.alias("line"))


STRIP = 64


def strips_of(spark: SparkSession, path: str, lines: int = STRIP) -> DataFrame:
    """One row per strip of raster lines: path, h, w, top, n (channels) and the strip's bytes as they are stored."""
    i = spark.read.format("image").load(path).select("image.*")
    i = i.select(F.col("origin").alias("path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("n"), "data")
    tops = i.withColumn("top", F.explode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(lines))))
    line = F.col("w") * F.col("n")
    return tops.select("path", "h", "w", "top", "n", F.substring(F.col("data"), F.col("top") * line + 1, F.lit(lines) * line).alias("strip"))


def cells_of(spark: SparkSession, path: str) -> DataFrame:
    """Gray cells; a one-bit file is stored by the source in three equal channels, of which the first is used."""
    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                h, w, top, n = (batch.column(k)[i].as_py() for k in ("h", "w", "top", "n"))
                gray = np.frombuffer(batch.column("strip")[i].as_buffer(), np.uint8)[::n]
                y, x = np.divmod(np.arange(len(gray), dtype=np.int32), w)
                name = pa.array([batch.column("path")[i].as_py()] * len(gray), pa.string())
                size = [pa.array(np.full(len(gray), v, np.int32)) for v in (h, w)]
                yield pa.RecordBatch.from_arrays([name, *size, pa.array(y + top), pa.array(x), pa.array(gray.astype(np.int32))], names=["path", "h", "w", "y", "x", "gray"])

    strips = strips_of(spark, path)
    return strips.repartition("path", "top").mapInArrow(decode, "path string, h int, w int, y int, x int, gray int")


def binary_masks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Mask runs (path, y, x0, x1) and the files whose values fit no binary encoding."""
    from regionmatch.operators.domains import runs_from_cells

    cells = cells_of(spark, path)
    return runs_from_cells(cells.filter("gray <> 0"), ["path"]), bad_encodings(cells, ["path"], "gray")
