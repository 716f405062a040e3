"""Views over the given tables that play the roles of rasters, grids, manifests and labels,
each with the SQL text of the same view for the cross-check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regionmatch.operators.ordering import id_bucket, position


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# ---- reviewed pixels with predictions ---------------------------------------------------


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per reviewed pixel: query, pos, blank and two stored predictions."""
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("query"),
        (F.col("l_returnflag") == "R").alias("pos"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).alias("blank"),
        (F.col("l_discount") * 10).alias("p_a"),
        (F.col("l_tax") * 12.5).alias("p_b"),
        F.concat_ws(
            ":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_quantity").cast("long").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
            F.round(F.col("l_discount") * 100).cast("long").cast("string"),
            F.round(F.col("l_tax") * 100).cast("long").cast("string"),
            "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyyMMdd"),
        ).alias("cell"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


PIXELS = """pixels AS (
  SELECT l_orderkey AS query, l_returnflag = 'R' AS pos,
         (l_returnflag = 'N' AND l_linestatus = 'O') AS blank,
         l_discount * 10 AS p_a, l_tax * 12.5 AS p_b,
         concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
           CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
           l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d')) AS cell,
         l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest: one request per order, with its document, kind and drawing size."""
    o = read(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("query"),
        F.col("o_custkey").alias("document_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "generated_cad").otherwise("real").alias("kind"),
        (40 + key % 17).cast("int").alias("width"),
        (30 + key % 13).cast("int").alias("height"),
    )


REQUESTS = """requests AS (
  SELECT o_orderkey AS query, o_custkey AS document_id,
         CASE o_orderpriority WHEN '5-LOW' THEN 'generated_cad' ELSE 'real' END AS kind,
         CAST(40 + o_orderkey % 17 AS INT) AS width, CAST(30 + o_orderkey % 13 AS INT) AS height
  FROM orders)"""


# ---- rasters ----------------------------------------------------------------------------


def _rows_of_images(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings").select(F.col("label").alias("image"), "vec_id", "embedding")
    sizes = e.groupBy("image").agg(F.count("*").cast("int").alias("h"))
    rows = position(e, ["image"], [F.col("vec_id")], id_bucket(F.col("vec_id")), "y")
    return rows.withColumn("y", (F.col("y") - 1).cast("int")).join(sizes, "image")


def px(spark: SparkSession, sf: str) -> DataFrame:
    """Gray rasters: one image per label, one raster row per vector. The rows are dealt to as many parts as the session
    shuffles to before they become cells; by their own bytes they would be joined to a few parts."""
    rows = _rows_of_images(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image", "y")
    cells = rows.select("image", "h", F.lit(64).alias("w"), "y", F.posexplode("embedding").alias("x", "_v"))
    gray = F.floor((F.col("_v").cast("double") + 1) * 127.5).cast("int")
    return cells.select("image", "h", "w", "y", "x", gray.alias("gray"))


PX = """rowsofimages AS (
  SELECT label AS image, CAST(count(*) OVER (PARTITION BY label) AS INT) AS h, 64 AS w,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS y, embedding
  FROM embeddings),
px AS (
  SELECT image, h, w, y, CAST(i - 1 AS INT) AS x,
         CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS INT) AS gray
  FROM rowsofimages, range(1, 65) t(i))"""


def grid_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Feature grid: one cell per vector, eight cells to a grid row, stride 8. Where the vectors do not fill the
    last row, its other cells show the first vectors again."""
    gh = F.ceil(F.col("h") / 8).cast("int")
    rows = _rows_of_images(spark, sf).select("image", gh.alias("gh"), F.explode(F.sequence(F.col("y"), gh * 8 - 1, F.col("h"))).alias("_at"), "embedding")
    return rows.select(
        "image",
        "gh",
        F.lit(8).alias("gw"),
        F.floor(F.col("_at") / 8).cast("int").alias("gy"),
        (F.col("_at") % 8).cast("int").alias("gx"),
        F.col("embedding").alias("vec"),
    )


GRID = """rowsofimages AS (
  SELECT label AS image, CAST(count(*) OVER (PARTITION BY label) AS INT) AS h, 64 AS w,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS y, embedding
  FROM embeddings),
grid AS (
  SELECT image, gh, 8 AS gw, CAST(i // 8 AS INT) AS gy, CAST(i % 8 AS INT) AS gx, vec
  FROM (SELECT image, (h + 7) // 8 AS gh, unnest(range(y, (h + 7) // 8 * 8, h)) AS i, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec FROM rowsofimages))"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Four query rectangles per raster, half-open, in raster pixels."""
    images = read(spark, sf, "embeddings").select(F.col("label").alias("image")).distinct()
    b = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    x0 = ((7 * F.col("image") + 13 * F.col("k")) % 48).cast("int")
    y0 = ((5 * F.col("image") + 9 * F.col("k")) % 24).cast("int")
    return b.select(
        "image",
        (F.col("image") * 10 + F.col("k")).cast("int").alias("query"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 4 + 2 * F.col("k")).cast("int").alias("x1"),
        (y0 + 3 + F.col("k")).cast("int").alias("y1"),
    )


BOXES = """boxes AS (
  SELECT image, CAST(image * 10 + k AS INT) AS query, x0, y0, x0 + 4 + 2 * k AS x1, y0 + 3 + k AS y1
  FROM (SELECT image, CAST(k AS INT) AS k, CAST((7 * image + 13 * k) % 48 AS INT) AS x0,
               CAST((5 * image + 9 * k) % 24 AS INT) AS y0
        FROM (SELECT DISTINCT label AS image FROM embeddings), range(0, 4) t(k)))"""


def wide_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Two query rectangles per raster that are large enough for corner crops and turned templates."""
    images = read(spark, sf, "embeddings").select(F.col("label").alias("image")).distinct()
    b = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k"))
    x0, y0 = ((7 * F.col("image")) % 20).cast("int"), ((5 * F.col("image")) % 12).cast("int")
    return b.select(
        "image",
        (F.col("image") * 10 + F.col("k")).cast("int").alias("query"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 26 + 14 * F.col("k")).cast("int").alias("x1"),
        (y0 + 24 + 6 * F.col("k")).cast("int").alias("y1"),
    )


WIDE_BOXES = """boxes AS (
  SELECT image, CAST(image * 10 + k AS INT) AS query, x0, y0, x0 + 26 + 14 * k AS x1, y0 + 24 + 6 * k AS y1
  FROM (SELECT image, CAST(k AS INT) AS k, CAST((7 * image) % 20 AS INT) AS x0, CAST((5 * image) % 12 AS INT) AS y0
        FROM (SELECT DISTINCT label AS image FROM embeddings), range(0, 2) t(k)))"""


def text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled classifier rows with a grouping column."""
    d = read(spark, sf, "documents").select("doc_id", "source", "text", "n_chars")
    lab = read(spark, sf, "labels")
    words = F.size(F.split("text", r"\s+"))
    lines = F.size(F.split("text", "\n"))
    digits = F.regexp_count("text", F.lit("[0-9]"))
    upper = F.regexp_count("text", F.lit("[A-Z]"))
    return d.join(lab, "doc_id").select(
        "doc_id",
        F.col("source").alias("document_id"),
        (F.col("quality") == 1).alias("pos"),
        (F.col("toxic") == 1).alias("toxic"),
        F.ln(F.col("n_chars") + 1.0).alias("f_chars"),
        F.ln(words + 1.0).alias("f_words"),
        lines.cast("double").alias("f_lines"),
        (digits / (F.col("n_chars") + 1.0)).alias("f_digits"),
        (upper / (F.col("n_chars") + 1.0)).alias("f_upper"),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Active hours of each user: a sparse one-row-per-user mask."""
    e = read(spark, sf, "events")
    hour = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour("ts")
    return e.select(F.col("user_id").alias("row"), hour.alias("x")).distinct()


SEGMENTS = """segments AS (
  SELECT DISTINCT user_id AS row, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS x FROM events)"""
