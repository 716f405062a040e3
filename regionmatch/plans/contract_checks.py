"""Queries over the manifest: contract rules, region algebra on label boxes, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionmatch.operators import contracts, domains, metrics
from regionmatch.plans import fixtures as fx
from regionmatch.session import cut_lineage

# ---- manifest with some broken rows -----------------------------------------------------


def manifest(spark, sf):
    """Manifest rows from orders; arithmetic on the key breaks some of them."""
    r = fx.requests(spark, sf)
    k = F.col("query")
    text = lambda c: c.cast("string")
    box = lambda *v: F.array(*[F.lit(e).cast("int") if isinstance(e, int) else e.cast("int") for e in v])
    return r.select(
        F.when(k % 97 == 0, "-bad").when(k % 89 == 0, F.concat(F.lit("q-"), text(k - 1))).otherwise(
            F.concat(F.lit("q-"), text(k))).alias("id"),
        F.when(k % 83 == 0, "../x.png").when(k % 79 == 0, "/abs.png").when(k % 73 == 0, "a/../../b.png")
        .when(k % 71 == 0, "").when(k % 67 == 0, "a\\b.png")
        .otherwise(F.concat(F.lit("drawings/../drawings/"), text(F.col("document_id")), F.lit(".png"))).alias("image"),
        F.when(k % 59 == 0, None).otherwise(text(F.col("document_id"))).alias("document_id"),
        "kind",
        F.when(k % 101 == 0, 0).otherwise(F.col("width")).alias("width"),
        "height",
        F.when(k % 103 == 0, box(1, 1, 2)).otherwise(
            box(k % 20, k % 15, k % 20 + 1 + k % 30, k % 15 + k % 12)).alias("query_box"),
        F.when(k % 4 == 0, F.array(box(k % 10, k % 7, k % 10 + 3, k % 7 + 2)))
        .when(k % 53 == 0, F.array(box(5, 5, 5, 9))).otherwise(F.array().cast("array<array<int>>")).alias("context_boxes"),
        F.when(k % 5 == 0, F.array(F.lit("positive_boxes"), F.lit("other")))
        .when(k % 47 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lit("positive_boxes"), F.lit("negative_mask"))).alias("label_fields"),
        F.array(box(k % 11, k % 7, k % 11 + 4 + k % 40, k % 7 + 5)).alias("label_boxes"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.when(k % 61 == 0, "").otherwise("m.png"))).alias("mask_paths"),
    )


def manifest_violations(spark, sf):
    return contracts.manifest_violations(manifest(spark, sf))


def label_free_violations(spark, sf):
    return contracts.manifest_violations(manifest(spark, sf), require_labels=False)


def duplicate_ids(spark, sf):
    return contracts.duplicates(manifest(spark, sf), "id")


def path_safety(spark, sf):
    m = manifest(spark, sf).select("id", "image", contracts.escapes_root(F.col("image")).alias("escapes"),
                                   contracts.unsafe_member(F.col("image")).alias("unsafe"))
    return m.filter("escapes or unsafe")


def label_free_export(spark, sf):
    """The valid requests, reduced to the public fields."""
    from regionmatch.sources.sinks import label_free

    m = manifest(spark, sf)
    bad = contracts.manifest_violations(m, require_labels=False).select("id").distinct()
    out = label_free(m.join(bad, "id", "left_anti"))
    return out.withColumns({"query_box": F.concat_ws(",", "query_box"),
                            "context_boxes": F.to_json("context_boxes")})


def unexpected_fields(spark, sf):
    """Requests whose stored JSON carries fields beyond the contract."""
    e = fx.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.lit("x.png").alias("image"),
                           F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderstatus")).alias("labels"),
                           F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey")).alias("document_id"))).alias("js"))
    return contracts.unexpected_fields(e.withColumn("names", F.json_object_keys("js")), "id", "names")


def partition_leak(spark, sf):
    """Documents that occur in more than one split when requests are split at random."""
    r = fx.requests(spark, sf).withColumn("split", F.when(F.col("query") % 10 == 0, "val").otherwise("train"))
    return contracts.partition_leaks(r, "document_id", "split")


def split_kind_rollup(spark, sf):
    r = fx.requests(spark, sf).withColumn("split", F.when(F.col("document_id") % 5 == 0, "val").otherwise("train"))
    return r.rollup("split", "kind").agg(F.count("*").alias("queries"), F.countDistinct("document_id").alias("documents"))


def mask_encoding(spark, sf):
    """Masks (here lines of an order) whose values fit neither binary encoding."""
    v = fx.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_tax") > 0.06, 255).otherwise(1)).otherwise(0).alias("v"))
    return contracts.bad_encodings(v, ["query"], "v")


def result_records(spark, sf):
    """A table of result records, one per customer, some of them broken."""
    c = fx.read(spark, sf, "customer")
    k = F.col("c_custkey")
    sha = lambda n: F.substring(F.sha2(k.cast("string"), 256), 1, n)
    names = F.array(*[F.lit(n) for n in contracts.RECORD_FIELDS])
    return c.select(
        k.alias("id"),
        F.when(k % 31 == 0, F.array_append(names, F.lit("surplus"))).when(k % 37 == 0, F.slice(names, 1, 12)).otherwise(names).alias("fields"),
        F.when(k % 29 == 0, "1").otherwise("1.0").alias("schema_version"),
        F.when(k % 23 == 0, "http://example.org/r").when(k % 19 == 0, "https://user@example.org/r")
        .when(k % 17 == 0, "https://host.invalid/r").when(k % 13 == 0, "REPLACE_ME").otherwise("https://example.org/r").alias("repository"),
        F.when(k % 11 == 0, sha(39)).otherwise(sha(40)).alias("commit"),
        F.when(k % 7 == 0, "python run.py --inputs a --data-root b")
        .when(k % 5 == 0, "python run.py --inputs a --inputs=b --data-root c --output-dir d")
        .when(k % 3 == 0, "python run.py --inputs --data-root c --output-dir=d")
        .otherwise("python run.py --inputs a --data-root=b --output-dir c").alias("inference_command"),
        F.when(k % 41 == 0, "../env.txt").when(k % 43 == 0, "c:env.txt").otherwise("env/requirements.txt").alias("environment"),
        F.when(k % 47 == 0, "out/").otherwise("out/metrics.json").alias("validation_metrics"),
        F.when(k % 53 == 0, "  ").otherwise("8 cores").alias("hardware"),
        F.when(k % 59 == 0, F.lit(-1.0)).when(k % 61 == 0, F.lit(float("nan"))).otherwise(F.lit(3.5)).alias("runtime_seconds"),
        F.when(k % 2 == 0, F.lit(100.0)).alias("peak_memory_mb"),
        F.when(k % 67 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0)).alias("time_spent_hours"),
        F.array(F.struct(F.when(k % 71 == 0, "ftp://x/y").otherwise("https://example.org/w").alias("url"),
                         F.when(k % 73 == 0, sha(63)).otherwise(sha(64)).alias("sha256"),
                         F.when(k % 79 == 0, 0).otherwise(5).cast("long").alias("bytes"))).alias("weights"),
        F.when(k % 83 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("none"))).alias("external_resources"),
        F.when(k % 89 == 0, F.array(F.lit("<fill in>"))).otherwise(F.array().cast("array<string>")).alias("ai_tools"),
    )


def record_violations(spark, sf):
    return contracts.broken_rules(result_records(spark, sf), "id", contracts.record_rules())


def gallery_violations(spark, sf):
    p = fx.read(spark, sf, "part")
    k = F.col("p_partkey")
    box = lambda *v: F.array(*[e.cast("int") for e in v])
    g = p.select(
        F.when(k % 97 == 0, F.lit("0")).otherwise(k.cast("string")).alias("id"),
        F.when(k % 31 == 0, "").otherwise(F.col("p_name")).alias("title"),
        F.when(k % 29 == 0, "assets/../x.png").when(k % 23 == 0, "img/x.png").when(k % 19 == 0, "assets/a.GIF")
        .otherwise("assets/a/b.JPG").alias("image"),
        F.when(k % 37 == 0, 0).otherwise(50).alias("width"), F.lit(40).alias("height"),
        box(k % 30, k % 20, k % 30 + 1 + k % 25, k % 20 + 4).alias("query_box"),
        F.array(box(k % 13, k % 11, k % 13 + 5, k % 11 + k % 9)).alias("label_boxes"))
    return contracts.gallery_violations(g)


# ---- label boxes ------------------------------------------------------------------------

_BOX_ROWS = (  # kind, condition on the key, x0, y0, x1, y1 in terms of the key
    ("positive", "true", "k % 11", "k % 7", "k % 11 + 6 + k % 9", "k % 7 + 5 + k % 5"),
    ("positive", "k % 3 = 0", "3 + k % 5", "3 + k % 4", "11 + k % 5", "11 + k % 4"),
    ("negative", "true", "20 + k % 5", "8 + k % 6", "28 + k % 5", "14 + k % 6"),
    ("blank", "k % 2 = 0", "22 + k % 3", "10 + k % 3", "25 + k % 3", "12 + k % 3"),
    ("known", "k % 16 = 0", "0", "0", "24", "20"),
    ("known", "k % 4 = 0 and k % 16 <> 0", "0", "0", "width", "height"),
    ("excluded", "true", "k % 11 + 1", "k % 7", "k % 11 + 4", "k % 7 + 2"),
    ("excluded", "k % 5 = 0", "k % 11 + 5", "k % 7 + 2", "k % 11 + 9", "k % 7 + 5"),
    ("predicted", "true", "k % 13", "k % 9", "k % 13 + 9 + k % 7", "k % 9 + 7"),
)


def label_boxes(spark, sf):
    r = fx.requests(spark, sf).withColumn("k", F.col("query"))
    rows = F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(kind).alias("kind"), *[F.expr(e).cast("int").alias(n) for n, e in
                                                                   zip(("x0", "y0", "x1", "y1"), edges)]))
        for kind, cond, *edges in _BOX_ROWS])
    return r.select("query", F.inline(F.filter(rows, lambda b: b.isNotNull())))


def _flags(spark, sf):
    b = label_boxes(spark, sf)
    # Whether a request has an explicit known region follows from its own boxes.
    return domains.with_known(domains.flag_runs(domains.slabs(domains.mark_explicit(b))))


def box_pixels(spark, sf):
    """Pixels of every box kind per query, overlaps counted once."""
    flags = domains.flag_runs(domains.slabs(label_boxes(spark, sf)))
    return flags.groupBy("query").agg(*[F.sum(F.when(F.col(k), domains.area()).otherwise(0)).cast("long").alias(k) for k in domains.KINDS])


def region_runs(spark, sf):
    """Maximal runs of the positive region of each query."""
    f = domains.flag_runs(domains.slabs(label_boxes(spark, sf).filter("kind = 'positive'")), ["positive"])
    return f.groupBy("query").agg(F.sum("rows").alias("runs"), F.sum(domains.area()).cast("long").alias("pixels"))


def domain_metadata(spark, sf):
    return domains.domain_metadata(_flags(spark, sf), fx.requests(spark, sf))


def domain_violations(spark, sf):
    return domains.domain_violations(_flags(spark, sf), fx.requests(spark, sf).select("query"))


def run_confusion(spark, sf):
    return domains.run_confusion(_flags(spark, sf))


def region_report(spark, sf):
    """From boxes to the document-macro report, leaving out requests that break the contract."""
    totals = cut_lineage(domains.domain_totals(_flags(spark, sf)))
    r = fx.requests(spark, sf).select("query", "document_id")
    bad = domains.violations_of(totals, r).select("query").distinct()
    m = metrics.query_metrics(domains.confusion_of(totals).join(bad, "query", "left_anti").join(r, "query"))
    return metrics.summary(m).select("examples", "documents", "tp", "fp", "fn", "tn",
                                     *[F.round(n, 6).alias(n) for n in ("document_macro_iou", "mean_query_iou",
                                                                        "global_precision", "global_recall")])


def known_pixels(spark, sf):
    """Sparse scored pixels with their flags, summed per query and row."""
    p = domains.pixels_of(_flags(spark, sf))
    return p.groupBy("query", "y").agg(F.count("*").alias("pixels"), F.sum("x").alias("sum_x"),
                                       F.count_if("pos").alias("pos"), F.count_if("blank").alias("blank"))


def cell_fractions(spark, sf):
    f = domains.majority_pool(domains.cell_fractions(_flags(spark, sf), 4))
    return f.select("query", "gy", "gx", F.round("known", 6).alias("known"), F.round("positive", 6).alias("positive"), "is_positive")


def cell_iou(spark, sf):
    """Cell-level IoU weighted by the known share, predictions taken at cell level."""
    f = domains.cell_fractions(_flags(spark, sf), 4, ("positive", "predicted"))
    j = f.withColumns({"hit": F.col("predicted") >= 0.5 * F.col("known"), "y": F.col("positive") / F.col("known")})
    w = F.col("known")
    inter = F.sum(F.when(F.col("hit"), w * F.col("y")).otherwise(0.0))
    union = F.sum(F.when(F.col("hit"), w).otherwise(w * F.col("y")))
    return j.groupBy("query").agg(F.round(F.try_divide(inter, union), 6).alias("iou"))


def mask_difference(spark, sf):
    return domains.changed_pixels(_flags(spark, sf), "positive", "predicted")


def segment_runs(spark, sf):
    """Maximal runs of a sparse mask."""
    s = fx.segments(spark, sf).withColumn("y", F.lit(0))
    return domains.runs_from_cells(s, ["row"]).select("row", "x0", "x1")


def run_overlap(spark, sf):
    """Overlap of each row's active hours with the same row shifted by a day."""
    s = fx.segments(spark, sf).withColumn("y", F.lit(0))
    a = domains.runs_from_cells(s, ["row"])
    b = a.withColumns({"x0": F.col("x0") + 24, "x1": F.col("x1") + 24})
    return domains.run_overlap(a, b, ["row"], block=64)


QUERIES = {f.__name__: f for f in (
    manifest_violations, label_free_violations, duplicate_ids, path_safety, label_free_export, unexpected_fields,
    partition_leak, split_kind_rollup, mask_encoding, record_violations, gallery_violations, box_pixels, region_runs,
    domain_metadata, domain_violations, run_confusion, region_report, known_pixels, cell_fractions, cell_iou,
    mask_difference, segment_runs, run_overlap)}


# ---- SQL twins --------------------------------------------------------------------------

_MANIFEST = f"""WITH {fx.REQUESTS}, manifest AS (SELECT
  CASE WHEN query % 97 = 0 THEN '-bad' WHEN query % 89 = 0 THEN 'q-' || (query - 1) ELSE 'q-' || query END AS id,
  CASE WHEN query % 83 = 0 THEN '../x.png' WHEN query % 79 = 0 THEN '/abs.png' WHEN query % 73 = 0 THEN 'a/../../b.png'
       WHEN query % 71 = 0 THEN '' WHEN query % 67 = 0 THEN 'a\\b.png' ELSE 'drawings/../drawings/' || document_id || '.png' END AS image,
  CASE WHEN query % 59 = 0 THEN NULL ELSE CAST(document_id AS VARCHAR) END AS document_id, kind,
  CASE WHEN query % 101 = 0 THEN 0 ELSE width END AS width, height, query % 103 = 0 AS short_box,
  query % 20 AS qx0, query % 15 AS qy0, query % 20 + 1 + query % 30 AS qx1, query % 15 + query % 12 AS qy1,
  CASE WHEN query % 4 = 0 THEN 1 WHEN query % 53 = 0 THEN 2 ELSE 0 END AS ctx, query % 10 AS cx0, query % 7 AS cy0,
  CASE WHEN query % 5 = 0 THEN 1 WHEN query % 47 = 0 THEN 2 ELSE 0 END AS fields, query % 61 = 0 AND query % 5 <> 0 AS empty_mask,
  query % 11 AS lx0, query % 7 AS ly0, query % 11 + 4 + query % 40 AS lx1, query % 7 + 5 AS ly1
  FROM requests),
free AS (
  SELECT id, 'bad_id' AS rule FROM manifest WHERE NOT regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9._-]{{0,127}}')
  UNION ALL SELECT id, 'missing_image' FROM manifest WHERE image = ''
  UNION ALL SELECT id, 'bad_size' FROM manifest WHERE width <= 0
  UNION ALL SELECT id, 'bad_query_box' FROM manifest WHERE short_box OR NOT (qx0 < qx1 AND qx1 <= width AND qy0 < qy1 AND qy1 <= height)
  UNION ALL SELECT id, 'bad_context_box' FROM manifest WHERE ctx = 2 OR (ctx = 1 AND NOT (cx0 + 3 <= width AND cy0 + 2 <= height))
  UNION ALL SELECT id, 'duplicate_id' FROM manifest GROUP BY id HAVING count(*) > 1),
full_rules AS (FROM free UNION ALL SELECT id, 'missing_document_id' FROM manifest WHERE document_id IS NULL
  UNION ALL SELECT id, 'labels_missing' FROM manifest WHERE fields = 2
  UNION ALL SELECT id, 'unknown_label_field' FROM manifest WHERE fields = 1
  UNION ALL SELECT id, 'bad_label_box' FROM manifest WHERE NOT (lx1 <= width AND ly1 <= height)
  UNION ALL SELECT id, 'bad_mask_path' FROM manifest WHERE empty_mask)"""

_RECORD_SQL = {
    "fields_differ": "k % 31 = 0 OR k % 37 = 0", "schema_version": "k % 29 = 0",
    "repository": "k % 23 = 0 OR k % 19 = 0 OR k % 17 = 0 OR k % 13 = 0", "commit": "k % 11 = 0",
    "inference_command": "k % 7 = 0 OR k % 5 = 0 OR k % 3 = 0", "environment": "k % 41 = 0 OR k % 43 = 0",
    "validation_metrics": "k % 47 = 0", "hardware": "k % 53 = 0", "runtime_seconds": "k % 59 = 0 OR k % 61 = 0",
    "time_spent_hours": "k % 67 = 0", "weights": "k % 71 = 0 OR k % 73 = 0 OR k % 79 = 0",
    "external_resources": "k % 83 = 0", "ai_tools": "k % 89 = 0"}

_LABEL_BOXES = "lb AS (" + " UNION ALL ".join(
    f"SELECT query, '{kind}' AS kind, {x0} AS x0, {y0} AS y0, {x1} AS x1, {y1} AS y1 FROM (SELECT *, query AS k FROM requests) WHERE {cond}"
    for kind, cond, x0, y0, x1, y1 in _BOX_ROWS) + ")"

_FLAGPX = f"""WITH {fx.REQUESTS}, {_LABEL_BOXES},
lpx AS (SELECT query, y, x, """ + ", ".join(f"bool_or(kind = '{k}') AS {k}" for k in domains.KINDS) + """
  FROM (SELECT query, kind, unnest(range(y0, y1)) AS y, x0, x1 FROM lb), LATERAL (SELECT unnest(range(x0, x1)) AS x) GROUP BY ALL),
px AS (SELECT lpx.*, CASE WHEN query % 4 = 0 THEN known ELSE positive OR negative OR blank END AS reviewed,
    (CASE WHEN query % 4 = 0 THEN known ELSE positive OR negative OR blank END) AND NOT excluded AS scored FROM lpx),
conf AS (SELECT query, count(*) FILTER (scored AND positive AND predicted) AS tp,
  count(*) FILTER (scored AND NOT positive AND predicted) AS fp, count(*) FILTER (scored AND positive AND NOT predicted) AS fn,
  count(*) FILTER (scored AND NOT positive AND NOT predicted) AS tn,
  count(*) FILTER (scored AND blank AND predicted) AS blank_fp, count(*) FILTER (scored AND blank) AS blank_pixels FROM px GROUP BY query),
viol AS (SELECT query, 'overlapping_labels' AS rule, count(*) AS pixels FROM px WHERE positive AND (negative OR blank) GROUP BY query
  UNION ALL SELECT query, 'outside_known', count(*) FROM px WHERE (positive OR negative OR blank) AND NOT reviewed GROUP BY query
  UNION ALL SELECT query, 'nothing_scored', 0 FROM requests WHERE query NOT IN (SELECT query FROM px WHERE scored))"""

_SEG_RUNS = f"""WITH {fx.SEGMENTS}, runs AS (SELECT row, min(x) AS x0, max(x) + 1 AS x1 FROM (
  SELECT row, x, x - row_number() OVER (PARTITION BY row ORDER BY x) AS g FROM segments) GROUP BY row, g)"""

ORACLE = {
    "manifest_violations": f"{_MANIFEST} SELECT * FROM full_rules",
    "label_free_violations": f"{_MANIFEST} SELECT * FROM free",
    "duplicate_ids": f"{_MANIFEST} SELECT id, count(*) AS copies FROM manifest GROUP BY id HAVING count(*) > 1",
    "path_safety": f"""{_MANIFEST} SELECT id, image,
      image IN ('../x.png', '/abs.png', 'a/../../b.png', '') AS escapes,
      image = '' OR image LIKE '/%' OR contains(image, '\\') OR list_contains(string_split(image, '/'), '..') AS unsafe
      FROM manifest WHERE escapes OR unsafe""",
    "label_free_export": f"""{_MANIFEST} SELECT id, image, width, height,
      concat_ws(',', qx0, qy0, qx1, qy1) AS query_box,
      CASE ctx WHEN 1 THEN '[[' || concat_ws(',', cx0, cy0, cx0 + 3, cy0 + 2) || ']]' ELSE '[]' END AS context_boxes
      FROM manifest WHERE id NOT IN (SELECT id FROM free)""",
    "unexpected_fields": """SELECT o_orderkey AS id, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'document_id' END,
      CASE WHEN o_orderkey % 7 = 0 THEN 'labels' END) AS unknown FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""",
    "partition_leak": """SELECT o_custkey AS document_id, count(DISTINCT o_orderkey % 10 = 0) AS partitions FROM orders
      GROUP BY 1 HAVING count(DISTINCT o_orderkey % 10 = 0) > 1""",
    "split_kind_rollup": f"""WITH {fx.REQUESTS} SELECT split, kind, count(*) AS queries, count(DISTINCT document_id) AS documents
      FROM (SELECT *, CASE WHEN document_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM requests) GROUP BY ROLLUP (split, kind)""",
    "mask_encoding": """WITH v AS (SELECT l_orderkey AS query, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_tax > 0.06 THEN 255 ELSE 1 END ELSE 0 END AS v FROM lineitem)
      SELECT query, count(*) FILTER (v NOT IN (0, 1)) AS not_01, count(*) FILTER (v NOT IN (0, 255)) AS not_0255 FROM v GROUP BY query
      HAVING not_01 > 0 AND not_0255 > 0""",
    "record_violations": "WITH r AS (SELECT c_custkey AS id, c_custkey AS k FROM customer) " + " UNION ALL ".join(
        f"SELECT id, '{name}' AS rule FROM r WHERE {cond}" for name, cond in _RECORD_SQL.items()),
    "gallery_violations": """WITH g AS (SELECT CASE WHEN p_partkey % 97 = 0 THEN '0' ELSE CAST(p_partkey AS VARCHAR) END AS id, p_partkey AS k FROM part)
      SELECT id, 'missing_title' AS rule FROM g WHERE k % 31 = 0
      UNION ALL SELECT id, 'bad_size' FROM g WHERE k % 37 = 0
      UNION ALL SELECT id, 'bad_image' FROM g WHERE k % 29 = 0 OR k % 23 = 0 OR k % 19 = 0
      UNION ALL SELECT id, 'bad_box' FROM g WHERE k % 37 = 0 OR k % 30 + 1 + k % 25 > 50 OR k % 9 = 0
      UNION ALL SELECT id, 'duplicate_id' FROM g GROUP BY id HAVING count(*) > 1""",
    "box_pixels": f"{_FLAGPX} SELECT query, " + ", ".join(f"count(*) FILTER ({k}) AS {k}" for k in domains.KINDS) + " FROM lpx GROUP BY query",
    "region_runs": f"""{_FLAGPX} SELECT query, count(DISTINCT (y, g)) AS runs, count(*) AS pixels FROM (SELECT query, y, x,
      x - row_number() OVER (PARTITION BY query, y ORDER BY x) AS g FROM lpx WHERE positive) GROUP BY query""",
    "domain_metadata": f"""{_FLAGPX} SELECT query, coalesce(kn, 0) AS original_known_pixels, coalesce(ex, 0) AS excluded_known_pixels,
      width * height - coalesce(sc, 0) AS unscored_pixels, width * height - coalesce(kn, 0) AS unknown_pixels,
      coalesce(ps > 0 AND ps = sc, false) AS positive_only FROM requests LEFT JOIN (SELECT query, count(*) FILTER (reviewed) AS kn,
      count(*) FILTER (reviewed AND excluded) AS ex, count(*) FILTER (scored) AS sc, count(*) FILTER (scored AND positive) AS ps
      FROM px GROUP BY query) USING (query)""",
    "domain_violations": f"{_FLAGPX} SELECT query, rule, CAST(pixels AS BIGINT) AS pixels FROM viol",
    "run_confusion": f"{_FLAGPX} SELECT * FROM conf",
    "region_report": f"""{_FLAGPX}, m AS (SELECT c.*, document_id, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fp + fn AS DOUBLE) END AS iou
      FROM conf c JOIN requests USING (query) WHERE query NOT IN (SELECT query FROM viol))
      SELECT count(*) AS examples, count(DISTINCT document_id) AS documents, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
      CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tn) AS BIGINT) AS tn,
      (SELECT round(avg(v), 6) FROM (SELECT avg(iou) AS v FROM m GROUP BY document_id)) AS document_macro_iou,
      round(avg(iou), 6) AS mean_query_iou, round(sum(tp) / CAST(sum(tp + fp) AS DOUBLE), 6) AS global_precision,
      round(sum(tp) / CAST(sum(tp + fn) AS DOUBLE), 6) AS global_recall FROM m""",
    "known_pixels": f"""{_FLAGPX} SELECT query, CAST(y AS INT) AS y, count(*) AS pixels, CAST(sum(x) AS BIGINT) AS sum_x,
      count(*) FILTER (positive) AS pos, count(*) FILTER (blank) AS blank FROM px WHERE scored GROUP BY query, y""",
    "cell_fractions": f"""{_FLAGPX}, cf AS (SELECT query, CAST(y // 4 AS BIGINT) AS gy, CAST(x // 4 AS BIGINT) AS gx, count(*) / 16.0 AS known,
      count(*) FILTER (positive) / 16.0 AS positive FROM px WHERE scored GROUP BY ALL)
      SELECT query, gy, gx, CAST(round(known, 6) AS DOUBLE) AS known, CAST(round(positive, 6) AS DOUBLE) AS positive, positive >= 0.5 * known AS is_positive FROM cf""",
    "cell_iou": f"""{_FLAGPX}, cf AS (SELECT query, y // 4 AS gy, x // 4 AS gx, CAST(count(*) AS DOUBLE) / 16 AS kn,
      CAST(count(*) FILTER (positive) AS DOUBLE) / 16 AS ps, count(*) FILTER (predicted) >= 0.5 * count(*) AS hit
      FROM px WHERE scored GROUP BY ALL)
      SELECT query, round(sum(CASE WHEN hit THEN ps ELSE 0 END) / nullif(sum(CASE WHEN hit THEN kn ELSE ps END), 0), 6) AS iou
      FROM cf GROUP BY query""",
    "mask_difference": f"{_FLAGPX} SELECT query, count(*) AS changed FROM px WHERE positive <> predicted GROUP BY query",
    "segment_runs": f"{_SEG_RUNS} SELECT * FROM runs",
    "run_overlap": f"""{_SEG_RUNS} SELECT a.row, CAST(count(*) AS BIGINT) AS overlap FROM segments a JOIN segments b ON a.row = b.row AND a.x = b.x + 24 GROUP BY a.row""",
}
