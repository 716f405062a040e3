"""Manifest files: one JSON object with ``examples``, or a bare list, or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from regionmatch.operators import contracts


def _int(v: Column) -> Column:
    """The number when the JSON value is a whole number; null for booleans, fractions and text."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "int"))


def _text(v: Column, path: str) -> Column:
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, path, "string"))


def _box(v: Column) -> Column:
    return F.transform(F.try_variant_get(v, "$", "array<variant>"), _int)


def _boxes(v: Column, path: str) -> Column:
    return F.transform(F.try_variant_get(v, path, "array<variant>"), _box)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per example, with strictly typed columns and the raw ``record``.

    A value of the wrong JSON type becomes null, which the contract rules report; nothing is
    coerced.
    """
    doc = spark.read.option("multiLine", "true").option("singleVariantColumn", "v").json(path)
    listed = F.try_variant_get("v", "$.examples", "array<variant>")
    bare = F.try_variant_get("v", "$", "array<variant>")
    rows = doc.select(F.explode(F.coalesce(listed, bare, F.array("v"))).alias("record"))
    r = F.col("record")
    labels = F.try_variant_get(r, "$.labels", "map<string,variant>")
    boxes = [F.coalesce(_boxes(r, f"$.labels.{k}_boxes"), F.array().cast("array<array<int>>")) for k in contracts.LABEL_KINDS]
    masks = F.filter(F.map_entries(labels), lambda e: e["key"].endswith("_mask"))
    return rows.select(
        *[_text(r, f"$.{n}").alias(n) for n in ("id", "image", "document_id", "kind")],
        *[_int(F.try_variant_get(r, f"$.{n}", "variant")).alias(n) for n in ("width", "height")],
        _box(F.try_variant_get(r, "$.query_box", "variant")).alias("query_box"),
        _boxes(r, "$.context_boxes").alias("context_boxes"),
        F.map_keys(labels).alias("label_fields"),
        F.concat(*boxes).alias("label_boxes"),
        F.transform(masks, lambda e: F.try_variant_get(e["value"], "$", "string")).alias("mask_paths"),
        F.map_keys(F.try_variant_get(r, "$", "map<string,variant>")).alias("fields"),
        r,
    )


def load_manifest(spark: SparkSession, path: str, require_labels: bool = True) -> DataFrame:
    """Read and check; a broken or empty manifest raises."""
    m = read_manifest(spark, path)
    if m.isEmpty():
        raise contracts.ContractError("a manifest needs at least one example")
    contracts.require_clean(contracts.manifest_violations(m, require_labels))
    return m


def load_requests(spark: SparkSession, path: str) -> DataFrame:
    """Label-free requests; any field beyond the contract raises."""
    m = load_manifest(spark, path, require_labels=False)
    contracts.require_clean(contracts.unexpected_fields(m, "id", "fields"))
    return m.select(*contracts.REQUEST_FIELDS)


def label_region_boxes(manifest: DataFrame) -> DataFrame:
    """Long form of every box: query, kind, x0, y0, x1, y1; query and context boxes are ``excluded``."""
    r = F.col("record")

    def tagged(kind):
        return lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("box"))

    parts = [F.transform(F.coalesce(_boxes(r, f"$.labels.{k}_boxes"), F.array().cast("array<array<int>>")), tagged(k))
             for k in contracts.LABEL_KINDS]
    kept_out = F.concat(F.array("query_box"), F.coalesce("context_boxes", F.array().cast("array<array<int>>")))
    parts.append(F.transform(kept_out, tagged("excluded")))
    long = manifest.select(F.col("id").alias("query"), F.explode(F.concat(*parts)).alias("_b"))
    return long.select("query", "_b.kind", *[F.get("_b.box", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def explicit_known(manifest: DataFrame) -> DataFrame:
    """Queries whose manifest names a known region."""
    has = F.array_contains("label_fields", "known_mask") | F.array_contains("label_fields", "known_boxes")
    return manifest.filter(F.coalesce(has, F.lit(False))).select(F.col("id").alias("query"))


def label_mask_paths(manifest: DataFrame) -> DataFrame:
    """Long form of the mask files: query, kind, path."""
    r = F.col("record")
    parts = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.try_variant_get(r, f"$.labels.{k}_mask", "string").alias("path"))
                               for k in contracts.LABEL_KINDS]), lambda s: s["path"].isNotNull())
    return manifest.select(F.col("id").alias("query"), F.inline(parts))
