"""Contract rules over tables of records.

Each rule set is one narrow pass: every row yields an array of broken rules that is exploded.
Only checks across rows (duplicate ids, leaks between partitions) shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The label fields and request fields of the data contract.
LABEL_KINDS = ("positive", "negative", "known", "blank")
LABEL_FIELDS = tuple(k + s for k in LABEL_KINDS for s in ("_mask", "_boxes"))
REQUEST_FIELDS = ("id", "image", "width", "height", "query_box", "context_boxes")
ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


class ContractError(ValueError):
    """Raised in strict mode when a table breaks its contract."""


def broken_rules(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row per (record, broken rule)."""
    hits = [F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]
    found = F.filter(F.array(*hits), lambda r: r.isNotNull())
    return df.select(F.col(key), F.explode(found).alias("rule"))


def require_clean(violations: DataFrame) -> None:
    """Strict mode: fail on the first few violations."""
    first = violations.limit(5).collect()
    if first:
        raise ContractError("; ".join(str(r.asDict()) for r in first))


def blank_text(c: Column) -> Column:
    return c.isNull() | (c == "")


def bad_box(box: Column, width: Column, height: Column) -> Column:
    """True unless the box is four integers, non-empty and inside the drawing."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    inside = (x0 >= 0) & (x0 < x1) & (x1 <= width) & (y0 >= 0) & (y0 < y1) & (y1 <= height)
    return box.isNull() | (F.size(box) != 4) | ~F.coalesce(inside, F.lit(False))


def bad_boxes(boxes: Column, width: Column, height: Column) -> Column:
    return boxes.isNull() | F.exists(boxes, lambda b: bad_box(b, width, height))


def escapes_root(path: Column) -> Column:
    """True when a relative path is empty, absolute, or climbs above its root at any point."""
    step = lambda p: F.when(p == "..", -1).when((p == "") | (p == "."), 0).otherwise(1)
    walk = F.aggregate(
        F.split(path, "/"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, p: F.struct((acc["at"] + step(p)).alias("at"), F.least(acc["low"], acc["at"] + step(p)).alias("low")),
    )
    return blank_text(path) | path.startswith("/") | (walk["low"] < 0)


def unsafe_member(path: Column) -> Column:
    """True when an archive member could be written outside its folder."""
    return blank_text(path) | path.startswith("/") | path.contains("\\") | F.array_contains(F.split(path, "/"), "..")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def manifest_rules(require_labels: bool = True) -> dict[str, Column]:
    """Per-row rules of a manifest table with columns id, image, document_id, kind, width, height,
    query_box, context_boxes, label_fields, label_boxes (all label boxes), mask_paths."""
    w, h = F.col("width"), F.col("height")
    rules = {
        "bad_id": F.col("id").isNull() | ~F.col("id").rlike(ID_PATTERN),
        "missing_image": blank_text(F.col("image")),
        "bad_size": w.isNull() | h.isNull() | (w <= 0) | (h <= 0),
        "bad_query_box": bad_box(F.col("query_box"), w, h),
        "bad_context_box": bad_boxes(F.coalesce("context_boxes", F.array().cast("array<array<int>>")), w, h),
    }
    if require_labels:
        rules |= {
            "missing_document_id": blank_text(F.col("document_id")),
            "missing_kind": blank_text(F.col("kind")),
            "labels_missing": F.col("label_fields").isNull() | (F.size("label_fields") == 0),
            "unknown_label_field": F.size(
                F.array_except(F.coalesce("label_fields", F.array().cast("array<string>")),
                               F.array(*[F.lit(n) for n in LABEL_FIELDS]))
            ) > 0,
            "bad_label_box": bad_boxes(F.coalesce("label_boxes", F.array().cast("array<array<int>>")), w, h),
            "bad_mask_path": F.exists(F.coalesce("mask_paths", F.array().cast("array<string>")), blank_text),
        }
    return rules


def manifest_violations(manifest: DataFrame, require_labels: bool = True) -> DataFrame:
    rows = broken_rules(manifest, "id", manifest_rules(require_labels))
    again = duplicates(manifest, "id").select("id", F.lit("duplicate_id").alias("rule"))
    return rows.unionByName(again)


def unexpected_fields(records: DataFrame, key: str, fields: str, allowed: Sequence[str] = REQUEST_FIELDS) -> DataFrame:
    """Records carrying fields beyond the allowed ones; ``fields`` is an array of names."""
    unknown = F.array_except(fields, F.array(*[F.lit(a) for a in allowed]))
    return records.select(key, F.concat_ws(",", F.array_sort(unknown)).alias("unknown")).filter(F.col("unknown") != "")


def partition_leaks(df: DataFrame, group: str, partition: str) -> DataFrame:
    """Groups that occur in more than one partition."""
    pairs = df.select(group, partition).distinct()
    return pairs.groupBy(group).agg(F.count("*").alias("partitions")).filter("partitions > 1")


def bad_encodings(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rasters whose values are neither within {0, 1} nor within {0, 255}."""
    flags = values.groupBy(*keys).agg(
        F.count_if(~F.col(value).isin(0, 1)).alias("not_01"), F.count_if(~F.col(value).isin(0, 255)).alias("not_0255")
    )
    return flags.filter("not_01 > 0 and not_0255 > 0")


# ---- result records ---------------------------------------------------------------------

# Fixed values of the record contract.
RECORD_FIELDS = (
    "schema_version", "repository", "commit", "inference_command", "environment", "weights", "validation_metrics",
    "hardware", "runtime_seconds", "peak_memory_mb", "time_spent_hours", "external_resources", "ai_tools",
)
RECORD_VERSION = "1.0"
COMMAND_FLAGS = ("--inputs", "--data-root", "--output-dir")


def unfilled(c: Column) -> Column:
    """Text that is missing, blank, or still a placeholder."""
    t = F.trim(c)
    return c.isNull() | (t == "") | c.contains("REPLACE_") | t.startswith("<")


def bad_https(c: Column) -> Column:
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    port = F.regexp_extract(F.coalesce(F.try_parse_url(c, F.lit("AUTHORITY")), F.lit("")), r":([^:\]]*)$", 1)
    return (
        unfilled(c)
        | (F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.lit("")) != "https")
        | ((port != "") & ~(port.rlike(r"^\d{1,5}$") & (F.coalesce(port.try_cast("int"), F.lit(-1)) <= 65535)))
        | F.coalesce(host, F.lit("")).isin("")
        | F.try_parse_url(c, F.lit("USERINFO")).isNotNull()
        | c.rlike(r"\s")
        | F.coalesce(host.endswith(".invalid"), F.lit(False))
    )


def bad_relative_file(c: Column) -> Column:
    return unfilled(c) | unsafe_member(c) | c.contains(":") | c.endswith("/") | (c == ".")


def bad_number(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (c < 0) | (F.abs(c) == float("inf"))


def bad_command(c: Column, flags: Sequence[str] = COMMAND_FLAGS) -> Column:
    """True unless the command names a program and carries each flag once with a value.

    Tokens are split at spaces; shell quoting is not interpreted.
    """
    tokens = F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")
    bad = unfilled(c) | (F.size(tokens) == 0) | F.get(tokens, F.lit(0)).startswith("--")
    for flag in flags:
        hits = F.filter(
            F.transform(tokens, lambda t, i: F.when((t == flag) | t.startswith(flag + "="), i)), lambda i: i.isNotNull()
        )
        at = F.get(hits, F.lit(0))
        token = F.get(tokens, at)
        value = F.when(token == flag, F.get(tokens, at + 1)).otherwise(F.substr(token, F.lit(len(flag) + 2)))
        bad = bad | (F.size(hits) != 1) | F.coalesce((value == "") | value.startswith("--"), F.lit(True))
    return bad


def record_rules() -> dict[str, Column]:
    """Rules over a table of result records; ``fields`` lists the names present in each."""
    weights = F.col("weights")
    needed = F.array(*[F.lit(n) for n in RECORD_FIELDS])
    return {
        "fields_differ": (F.size(F.array_except(needed, F.col("fields"))) > 0)
        | (F.size(F.array_except(F.col("fields"), needed)) > 0),
        "schema_version": F.col("schema_version") != RECORD_VERSION,
        "repository": bad_https(F.col("repository")),
        "commit": ~F.col("commit").rlike("^[0-9a-fA-F]{40}$"),
        "inference_command": bad_command(F.col("inference_command")),
        "environment": bad_relative_file(F.col("environment")),
        "validation_metrics": bad_relative_file(F.col("validation_metrics")),
        "hardware": unfilled(F.col("hardware")),
        "runtime_seconds": bad_number(F.col("runtime_seconds")),
        "time_spent_hours": bad_number(F.col("time_spent_hours")),
        "peak_memory_mb": F.col("peak_memory_mb").isNotNull() & bad_number(F.col("peak_memory_mb")),
        "weights": weights.isNull()
        | F.exists(
            weights,
            lambda w: bad_https(w["url"])
            | ~F.coalesce(w["sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
            | F.coalesce(w["bytes"] <= 0, F.lit(False)),
        ),
        "external_resources": F.col("external_resources").isNull() | F.exists("external_resources", unfilled),
        "ai_tools": F.col("ai_tools").isNull() | F.exists("ai_tools", unfilled),
    }


# Fixed value: where a gallery image may lie and its file types.
GALLERY_IMAGE = r"^(?i)assets/[A-Za-z0-9._/-]+\.(png|jpe?g|webp)$"


def gallery_violations(records: DataFrame) -> DataFrame:
    """Gallery records: unique id, title, sizes, public asset path and valid boxes."""
    w, h = F.col("width"), F.col("height")
    rules = {
        "bad_id": blank_text(F.col("id")),
        "missing_title": blank_text(F.col("title")),
        "bad_size": (w <= 0) | (h <= 0),
        "bad_image": ~F.col("image").rlike(GALLERY_IMAGE) | F.array_contains(F.split("image", "/"), ".."),
        "bad_box": bad_box(F.col("query_box"), w, h) | bad_boxes(F.col("label_boxes"), w, h),
    }
    again = duplicates(records, "id").select("id", F.lit("duplicate_id").alias("rule"))
    return broken_rules(records, "id", rules).unionByName(again)
