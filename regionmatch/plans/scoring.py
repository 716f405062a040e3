"""Queries that score stored predictions on reviewed pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from regionmatch.operators import compare, metrics, sampling
from regionmatch.operators.ordering import exact_quantiles, id_bucket, unit_bucket
from regionmatch.plans import fixtures as fx

CUT = 0.55
SWEEP = (0.35, 0.45, 0.55, 0.65, 0.75)
FINE = tuple(round(0.05 + 0.025 * i, 3) for i in range(37))
MIDDLE = 0.55


def _documents(spark, sf):
    return fx.requests(spark, sf).select("query", "document_id", "kind")


def _counts(spark, sf, prob="p_a", cut=CUT):
    """Counts per query first, attached to every request; a request without reviewed pixels has zeros."""
    c = metrics.confusion(fx.pixels(spark, sf), F.col(prob) > cut)
    return _documents(spark, sf).join(c, "query", "left").fillna(0, list(metrics.COUNTS))


def _r(*names):
    return {n: F.round(F.col(n), 6) for n in names}


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(fx.pixels(spark, sf), F.col("p_a") > CUT)


RATIOS = ("iou", "precision", "recall", "empty_target_false_positive_rate", "blank_false_positive_rate")


def query_metrics(spark, sf):
    m = metrics.query_metrics(_counts(spark, sf)).withColumns(_r(*RATIOS))
    return m.select("query", "document_id", "reviewed_pixels", "positive_pixels", *RATIOS)


def doc_macro(spark, sf):
    d = metrics.per_document(metrics.query_metrics(_counts(spark, sf)))
    return d.select("document_id", "queries", F.round("document_iou", 6).alias("document_iou"))


def report(spark, sf):
    s = metrics.summary(metrics.query_metrics(_counts(spark, sf)))
    return s.withColumns(_r("document_macro_iou", "mean_query_iou", "global_precision", "global_recall",
                            "empty_target_false_positive_rate", "blank_false_positive_rate"))


def pooled(spark, sf):
    return report(spark, sf).select("tp", "fp", "fn", "tn", "global_precision", "global_recall")


def rates(spark, sf):
    return report(spark, sf).select(
        "examples", "documents", "nonempty_target_examples", "empty_target_examples",
        "empty_target_false_positive_pixels", "empty_target_reviewed_pixels",
        "empty_target_false_positive_rate", "blank_false_positive_rate")


def dev_score(spark, sf):
    return metrics.dev_score(_counts(spark, sf)).withColumns(_r("doc_macro", "query_mean", "precision", "recall"))


def count_contract(spark, sf):
    """The contract on counts taken for the wrong blank class, so that rules fire."""
    c = metrics.confusion(fx.pixels(spark, sf).withColumn("blank", F.col("p_b") > 0.3), F.col("p_a") > CUT)
    return metrics.count_violations(c)


def _ious(spark, sf, thresholds, prob="p_a"):
    c = metrics.threshold_counts(fx.pixels(spark, sf), prob, thresholds, ["query"])
    return metrics.threshold_ious(c.join(_documents(spark, sf), "query"))


def threshold_sweep(spark, sf):
    s = metrics.threshold_sweep(_ious(spark, sf, SWEEP), SWEEP)
    return s.withColumns(_r("doc_macro", "query_mean"))


def fine_threshold_sweep(spark, sf):
    s = metrics.threshold_sweep(_ious(spark, sf, FINE, "p_b"), FINE)
    return s.withColumns(_r("doc_macro", "query_mean"))


def select_threshold(spark, sf):
    s = threshold_sweep(spark, sf)
    best = F.max_by(F.struct("threshold", "doc_macro"), F.struct("doc_macro", -F.col("threshold"))).alias("b")
    return s.agg(best).select("b.threshold", "b.doc_macro")


def threshold_oracle(spark, sf):
    b = metrics.best_threshold(_ious(spark, sf, SWEEP), SWEEP, MIDDLE)
    return b.select("query", "document_id", F.round("best_iou", 6).alias("best_iou"), "best_threshold",
                    F.round("gain", 6).alias("gain"))


def oracle_headroom(spark, sf):
    b = metrics.best_threshold(_ious(spark, sf, SWEEP), SWEEP, MIDDLE)
    docs = b.groupBy("document_id").agg(F.avg("best_iou").alias("best"), F.avg("default_iou").alias("base"))
    means = docs.agg(F.avg("best").alias("oracle"), F.avg("base").alias("default_score"))
    q = exact_quantiles(b, [], "best_threshold", (0.1, 0.25, 0.5, 0.75, 0.9), unit_bucket(F.col("_v")))
    return means.crossJoin(q).select(  # two single rows
        F.round("oracle", 6).alias("oracle"), F.round("default_score", 6).alias("default_score"),
        *[F.round(F.col("quantiles")[i], 6).alias(f"t_q{p}") for i, p in enumerate((10, 25, 50, 75, 90))])


def top_gains(spark, sf):
    b = metrics.best_threshold(_ious(spark, sf, SWEEP), SWEEP, MIDDLE)
    return b.withColumn("gain", F.round("gain", 6)).orderBy(F.desc("gain"), "query").limit(8).select(
        "query", "document_id", "best_threshold", "gain")


def iou_gain_curve(spark, sf):
    g = metrics.iou_gain_curve(_ious(spark, sf, SWEEP), SWEEP, MIDDLE)
    return g.withColumns(_r("iou", "gain"))


LEVELS = (0.1, 0.3, 0.5, 0.7, 0.9, 0.97)


def map_stats(spark, sf):
    """Label-free statistics of a probability map, with quantiles of its accepted part."""
    cells = fx.pixels(spark, sf)
    stats = metrics.accepted_stats(cells, "p_b", LEVELS)
    q = exact_quantiles(cells.filter(F.col("p_b") > 0.5), ["query"], "p_b", (0.1, 0.25, 0.5, 0.75),
                        unit_bucket(F.col("_v")))
    shares = [c for c in stats.columns if c.startswith("share_")]
    return stats.join(q, "query", "left").select(
        "query", "cells", *[F.round(c, 6).alias(c) for c in shares],
        *[F.round(F.coalesce(F.col("quantiles")[i], F.lit(0.0)), 6).alias(f"q{p}")
          for i, p in enumerate((10, 25, 50, 75))])


def threshold_features(spark, sf):
    """All label-free statistics of every map next to its best threshold; the query box is the cells of small quantity."""
    b = metrics.best_threshold(_ious(spark, sf, SWEEP, "p_b"), SWEEP, MIDDLE).select("query", "document_id", "best_threshold", "gain")
    f = metrics.threshold_features(fx.pixels(spark, sf), "p_b", F.col("quantity") <= 20, accept=0.3, least=2)
    return b.join(f, "query").select("query", "document_id", "best_threshold", F.round("gain", 6).alias("gain"), *[F.round(n, 6).alias(n) for n in f.columns if n != "query"])


def oracle_threshold_table(spark, sf):
    b = metrics.best_threshold(_ious(spark, sf, SWEEP, "p_b"), SWEEP, MIDDLE).filter(F.col("gain") >= 0.03)
    stats = metrics.accepted_stats(fx.pixels(spark, sf), "p_b", (0.5, 0.9))
    return b.join(stats, "query").select(
        "query", "document_id", "best_threshold", F.round("gain", 6).alias("gain"),
        F.round("default_iou", 6).alias("default_iou"), F.round("share_50", 6).alias("share_50"),
        F.round("share_90", 6).alias("share_90"))


def prediction_diff(spark, sf):
    """Pixels on which two stored predictions disagree, per query."""
    p = fx.pixels(spark, sf)
    d = p.groupBy("query").agg(F.count_if((F.col("p_a") > CUT) != (F.col("p_b") > CUT)).alias("changed"))
    return d.filter("changed > 0")


def residual_stack(spark, sf):
    """Final logit = base logit + half of the second model's logit, back to a probability."""
    from regionmatch.functions.scalars import logit, sigmoid

    p = fx.pixels(spark, sf).withColumn("p", sigmoid(logit(F.col("p_a"), 0.01) + 0.5 * logit(F.col("p_b"), 0.01)))
    out = metrics.threshold_ious(metrics.threshold_counts(p, "p", SWEEP, ["query"]).join(_documents(spark, sf), "query"))
    return metrics.threshold_sweep(out, SWEEP).withColumns(_r("doc_macro", "query_mean"))


def stored_logits(spark, sf):
    """A map stored as logits, read back as probabilities, against one stored directly."""
    from regionmatch.functions.scalars import sigmoid

    p = fx.pixels(spark, sf).withColumn("p", sigmoid((F.col("p_a") - 0.5) * 8))
    return p.groupBy("query").agg(F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.max("p"), 6).alias("max_p"))


def blend(spark, sf):
    p = fx.pixels(spark, sf).groupBy("query", "cell").agg(F.max("p_a").alias("p_a"), F.max("p_b").alias("p_b"))
    parts = [p.select("query", "cell", F.col(c).alias("p")) for c in ("p_a", "p_b")]
    b = compare.blend(parts, ["query", "cell"])
    return b.groupBy("query").agg(F.count("*").alias("cells"), F.round(F.sum("p"), 6).alias("sum_p"))


def _document_ious(spark, sf, prob, cut=CUT):
    return metrics.per_document(metrics.query_metrics(_counts(spark, sf, prob, cut)))


def _deltas(spark, sf):
    return compare.document_delta(_document_ious(spark, sf, "p_a"), _document_ious(spark, sf, "p_b"))


def paired_bootstrap(spark, sf):
    means = compare.bootstrap_means(_deltas(spark, sf), "document_id", id_bucket(F.col("document_id"), 256))
    return compare.bootstrap_interval(means).withColumns(_r("lo", "hi"))


def better_worse(spark, sf):
    return compare.better_worse(_deltas(spark, sf), 0.005).withColumns(_r("mean_delta"))


def fold_delta(spark, sf):
    folds = sampling.document_folds(_documents(spark, sf), 4)
    return compare.grouped_delta(_deltas(spark, sf), folds, "document_id", "fold").withColumns(_r("mean_delta"))


def query_delta(spark, sf):
    a, b = (metrics.query_metrics(_counts(spark, sf, p)).filter("iou is not null") for p in ("p_a", "p_b"))
    d = compare.changed_rows(a, b, "query", "iou", 0.02)
    return d.withColumns(_r("base", "candidate", "delta"))


def fold_score(spark, sf):
    """Score restricted to one fold's documents, next to the whole."""
    ious = _ious(spark, sf, SWEEP)
    one = sampling.document_folds(_documents(spark, sf), 4).filter("fold = 0").select("document_id")
    part = metrics.threshold_sweep(ious.join(one, "document_id", "left_semi"), SWEEP)
    whole = metrics.threshold_sweep(ious, SWEEP).select("threshold", F.col("doc_macro").alias("all_documents"))
    return part.join(whole, "threshold").withColumns(_r("doc_macro", "query_mean", "all_documents"))


def label_conflict(spark, sf):
    """Positive share, pixels and queries of a filtered subset of rows."""
    s = fx.pixels(spark, sf).filter((F.col("p_a") > 0.75) & (F.col("p_b") > 0.45))
    return s.agg(F.count("*").alias("pixels"), F.countDistinct("query").alias("queries"),
                 F.round(F.avg(F.col("pos").cast("double")), 6).alias("positive_share"))


def feature_auc(spark, sf):
    """Document-macro folded AUC of three features, best first."""
    rows = fx.pixels(spark, sf)
    rows = rows.withColumn("quantity", F.when(F.col("p_b") > 0.9, None).otherwise(F.col("quantity")))
    auc = metrics.feature_auc(rows, ["p_a", "p_b", "quantity"]).join(_documents(spark, sf), "query")
    docs = auc.groupBy("feature", "document_id").agg(F.avg("auc").alias("a"))
    out = docs.groupBy("feature").agg(F.round(F.avg("a"), 6).alias("auc"))
    return out.orderBy(F.desc("auc"), "feature").limit(40)


def expected_counts(spark, sf):
    """Pixel totals of every query against an expected table; mismatches only."""
    got = fx.pixels(spark, sf).groupBy("query").agg(
        F.count_if("pos").alias("positive"), F.count_if(~F.col("pos")).alias("negative"))
    want = fx.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % 3).alias("want_positive"),
        (F.col("o_orderkey") % 5).alias("want_negative"))
    j = want.join(got, "query", "left").fillna(0, ["positive", "negative"])
    return j.filter((F.col("positive") != F.col("want_positive")) | (F.col("negative") != F.col("want_negative")))


def missing_predictions(spark, sf):
    """Requests with no stored prediction; a scoring run must stop on any."""
    return fx.requests(spark, sf).select("query").join(
        fx.pixels(spark, sf).filter(F.col("p_a") > 0.95), "query", "left_anti")


def incremental(spark, sf):
    """Requests still to do when the ones with an accepted pixel are already written."""
    done = fx.pixels(spark, sf).filter(F.col("p_b") > CUT).select("query")
    return fx.requests(spark, sf).select("query", "document_id").join(done, "query", "left_anti")


def merge_check(spark, sf):
    """Row-aligned merge check of two per-query tables."""
    a, b = (fx.pixels(spark, sf).filter(F.col("p_b") > c).groupBy("query").agg(
        F.avg("p_a").alias("v"), F.max("quantity").alias("m")) for c in (0.2, 0.3))
    return compare.aligned_mismatches(a, b, ["query"], ["v", "m"], 1e-6)


def row_replay(spark, sf):
    """Rows of one sampled set that a replayed set lacks, and the reverse."""
    p = fx.pixels(spark, sf)
    a = p.filter(F.col("p_a") > 0.45).select("query", "pos", F.round(F.col("quantity")).cast("long").alias("quantity"))
    b = p.filter(F.col("p_a") > 0.55).select("query", "pos", F.round(F.col("quantity")).cast("long").alias("quantity"))
    return compare.replay_difference(a, b)


def nested_select(spark, sf):
    """Pick the best candidate on the other folds, score it on the held-out one."""
    from regionmatch.operators.selection import nested_choice

    ious = _ious(spark, sf, SWEEP).select("query", "document_id", "ious")
    folds = sampling.document_folds(_documents(spark, sf), 4)
    docs = ious.groupBy("document_id").agg(*[F.avg(F.col("ious")[k]).alias(f"c{k}") for k in range(len(SWEEP))])
    long = docs.join(folds, "document_id").unpivot(
        ["document_id", "fold"], [f"c{k}" for k in range(len(SWEEP))], "candidate", "score")
    return nested_choice(long).withColumns(_r("inner_score", "outer_score"))


def choose_threshold(spark, sf):
    """Per-query threshold from predicted gains, kept at the default below a margin."""
    from regionmatch.operators.selection import choose_with_margin

    curve = metrics.iou_gain_curve(_ious(spark, sf, SWEEP, "p_b"), SWEEP, MIDDLE)
    return choose_with_margin(curve, "gain", MIDDLE, 0.05).withColumns(_r("predicted_gain"))


QUERIES = {f.__name__: f for f in (
    confusion, query_metrics, doc_macro, pooled, rates, report, dev_score, count_contract, threshold_sweep,
    fine_threshold_sweep, select_threshold, threshold_oracle, oracle_headroom, top_gains, iou_gain_curve, map_stats,
    oracle_threshold_table, threshold_features, prediction_diff, residual_stack, stored_logits, blend, paired_bootstrap, better_worse,
    fold_delta, query_delta, fold_score, label_conflict, feature_auc, expected_counts, missing_predictions,
    incremental, merge_check, row_replay, nested_select, choose_threshold)}


# ---- SQL twins --------------------------------------------------------------------------

_BASE = f"WITH {fx.PIXELS}, {fx.REQUESTS}"


def _conf(name, prob="p_a", cut=CUT):
    return f"""{name} AS (
  SELECT query, count(*) FILTER ({prob} > {cut} AND pos) AS tp, count(*) FILTER ({prob} > {cut} AND NOT pos) AS fp,
         count(*) FILTER (NOT {prob} > {cut} AND pos) AS fn, count(*) FILTER (NOT {prob} > {cut} AND NOT pos) AS tn,
         count(*) FILTER ({prob} > {cut} AND blank) AS blank_fp, count(*) FILTER (blank) AS blank_pixels
  FROM pixels GROUP BY query)"""


def _met(name, src):
    return f"""{name} AS (
  SELECT c.*, document_id, tp + fp + fn + tn AS reviewed_pixels, tp + fn AS positive_pixels,
         CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fp + fn AS DOUBLE) END AS iou,
         tp / CAST(nullif(tp + fp, 0) AS DOUBLE) AS precision,
         tp / CAST(nullif(tp + fn, 0) AS DOUBLE) AS recall,
         CASE WHEN tp + fn = 0 THEN fp / CAST(nullif(tp + fp + fn + tn, 0) AS DOUBLE) END AS empty_target_false_positive_rate,
         blank_fp / CAST(nullif(blank_pixels, 0) AS DOUBLE) AS blank_false_positive_rate
  FROM (SELECT query, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn,
    coalesce(blank_fp, 0) AS blank_fp, coalesce(blank_pixels, 0) AS blank_pixels FROM requests LEFT JOIN {src} USING (query)) c JOIN requests USING (query))"""


_MET = f"{_BASE}, {_conf('c')}, {_met('m', 'c')}"
_REPORT = f"""{_MET}, d AS (SELECT document_id, avg(iou) AS iou FROM m GROUP BY 1),
s AS (SELECT count(*) AS examples, count(DISTINCT document_id) AS documents, count(iou) AS nonempty_target_examples,
  count(*) - count(iou) - count(*) FILTER (reviewed_pixels = 0) AS empty_target_examples, count(*) FILTER (reviewed_pixels = 0) AS nothing_scored, round((SELECT avg(iou) FROM d), 6) AS document_macro_iou,
  round(avg(iou), 6) AS mean_query_iou,
  round(sum(tp) / CAST(nullif(sum(tp + fp), 0) AS DOUBLE), 6) AS global_precision,
  round(sum(tp) / CAST(nullif(sum(tp + fn), 0) AS DOUBLE), 6) AS global_recall,
  CAST(coalesce(sum(fp) FILTER (iou IS NULL), 0) AS BIGINT) AS empty_target_false_positive_pixels,
  CAST(coalesce(sum(reviewed_pixels) FILTER (iou IS NULL), 0) AS BIGINT) AS empty_target_reviewed_pixels,
  round(sum(fp) FILTER (iou IS NULL) / CAST(nullif(sum(reviewed_pixels) FILTER (iou IS NULL), 0) AS DOUBLE), 6)
    AS empty_target_false_positive_rate,
  round(sum(blank_fp) / CAST(nullif(sum(blank_pixels), 0) AS DOUBLE), 6) AS blank_false_positive_rate,
  CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(blank_fp) AS BIGINT) AS blank_fp,
  CAST(sum(blank_pixels) AS BIGINT) AS blank_pixels FROM m)"""


def _sweep_ctes(prob, thresholds, base=_BASE, src="pixels"):
    """Long per-query IoUs: one row per query and threshold."""
    ts = ", ".join(f"({i}, CAST({t} AS DOUBLE))" for i, t in enumerate(thresholds))
    return f"""{base}, ts(k, threshold) AS (VALUES {ts}),
it AS (SELECT query, document_id, k, threshold,
         count(*) FILTER ({prob} > threshold AND pos) / CAST(count(*) FILTER (pos OR {prob} > threshold) AS DOUBLE) AS iou
       FROM {src} JOIN requests USING (query), ts GROUP BY ALL HAVING count(*) FILTER (pos) > 0),
g AS (SELECT *, iou - default_iou AS gain FROM (SELECT *, max(iou) FILTER (threshold = {MIDDLE}) OVER (PARTITION BY query) AS default_iou FROM it)),
best AS (SELECT query, document_id, iou AS best_iou, threshold AS best_threshold, gain, default_iou FROM g
         QUALIFY row_number() OVER (PARTITION BY query ORDER BY iou DESC, k) = 1)"""


_SWEEP_OUT = """ SELECT threshold, round(avg(d), 6) AS doc_macro, round(sum(s) / sum(n), 6) AS query_mean
FROM (SELECT threshold, document_id, avg(iou) AS d, sum(iou) AS s, count(*) AS n FROM it GROUP BY ALL) GROUP BY threshold"""

_FOLDS = """folds AS (SELECT document_id, (row_number() OVER (ORDER BY md5('0:' || document_id), document_id) - 1) % 4 AS fold
  FROM (SELECT DISTINCT document_id FROM requests))"""

_DELTA = f"""{_BASE}, {_conf('ca', 'p_a')}, {_met('ma', 'ca')}, {_conf('cb', 'p_b')}, {_met('mb', 'cb')}, {_FOLDS},
da AS (SELECT document_id, avg(iou) AS v FROM ma WHERE iou IS NOT NULL GROUP BY 1),
db AS (SELECT document_id, avg(iou) AS v FROM mb WHERE iou IS NOT NULL GROUP BY 1),
delta AS (SELECT document_id, db.v - da.v AS delta FROM da FULL JOIN db USING (document_id))"""

_SHARES = ", ".join(f"round(count(*) FILTER (p_b > {t}) / CAST(count(*) AS DOUBLE), 6) AS share_{int(round(t*100)):02d}" for t in LEVELS)


def _auc_sql(feature):
    return f"""SELECT '{feature}' AS feature, round(avg(a), 6) AS auc FROM (
  SELECT document_id, avg(greatest(auc, 1 - auc)) AS a FROM (
    SELECT query, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0)
             / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc
    FROM (SELECT query, pos, rank() OVER (PARTITION BY query ORDER BY v)
                 + (count(*) OVER (PARTITION BY query, v) - 1) / 2.0 AS r
          FROM (SELECT query, pos, coalesce(f, min(f) OVER (PARTITION BY query)) AS v
                FROM (SELECT query, pos, {feature} AS f FROM rows)) WHERE v IS NOT NULL)
    GROUP BY query HAVING count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0)
  JOIN requests USING (query) GROUP BY document_id)"""


ORACLE = {
    "confusion": f"{_BASE}, {_conf('c')} SELECT * FROM c",
    "query_metrics": f"{_MET} SELECT query, document_id, reviewed_pixels, positive_pixels, "
    + ", ".join(f"round({r}, 6) AS {r}" for r in RATIOS) + " FROM m",
    "doc_macro": f"{_MET} SELECT document_id, count(*) AS queries, round(avg(iou), 6) AS document_iou FROM m "
    "WHERE iou IS NOT NULL GROUP BY 1",
    "report": f"{_REPORT} SELECT * FROM s",
    "pooled": f"{_REPORT} SELECT tp, fp, fn, tn, global_precision, global_recall FROM s",
    "rates": f"{_REPORT} SELECT examples, documents, nonempty_target_examples, empty_target_examples, "
    "empty_target_false_positive_pixels, empty_target_reviewed_pixels, empty_target_false_positive_rate, "
    "blank_false_positive_rate FROM s",
    "dev_score": f"""{_MET} SELECT (SELECT round(avg(v), 6) FROM (SELECT avg(iou) AS v FROM m GROUP BY document_id)) AS doc_macro,
      round(avg(iou), 6) AS query_mean, round(sum(tp) / CAST(greatest(sum(tp + fp), 1) AS DOUBLE), 6) AS precision,
      round(sum(tp) / CAST(greatest(sum(tp + fn), 1) AS DOUBLE), 6) AS recall FROM m""",
    "count_contract": f"""WITH {fx.PIXELS}, c AS (SELECT query, count(*) FILTER (p_a > {CUT} AND NOT pos) AS fp,
      count(*) FILTER (NOT p_a > {CUT} AND NOT pos) AS tn, count(*) FILTER (p_a > {CUT} AND p_b > 0.3) AS blank_fp,
      count(*) FILTER (p_b > 0.3) AS blank_pixels FROM pixels GROUP BY query)
      SELECT query, 'blank_not_subset' AS rule FROM c
      WHERE blank_fp > least(fp, blank_pixels) OR blank_pixels > fp + tn""",
    "threshold_sweep": _sweep_ctes("p_a", SWEEP) + _SWEEP_OUT,
    "fine_threshold_sweep": _sweep_ctes("p_b", FINE) + _SWEEP_OUT,
    "select_threshold": _sweep_ctes("p_a", SWEEP) + f", sw AS ({_SWEEP_OUT}) "
    "SELECT threshold, doc_macro FROM sw ORDER BY doc_macro DESC, threshold LIMIT 1",
    "threshold_oracle": _sweep_ctes("p_a", SWEEP) + " SELECT query, document_id, round(best_iou, 6) AS best_iou, "
    "best_threshold, round(gain, 6) AS gain FROM best",
    "oracle_headroom": _sweep_ctes("p_a", SWEEP) + """ SELECT round((SELECT avg(v) FROM (SELECT avg(best_iou) AS v FROM best GROUP BY document_id)), 6) AS oracle,
      round((SELECT avg(v) FROM (SELECT avg(default_iou) AS v FROM best GROUP BY document_id)), 6) AS default_score, """
    + ", ".join(f"round(quantile_cont(best_threshold, {p / 100}), 6) AS t_q{p}" for p in (10, 25, 50, 75, 90)) + " FROM best",
    "top_gains": _sweep_ctes("p_a", SWEEP) + " SELECT query, document_id, best_threshold, round(gain, 6) AS gain FROM best "
    "ORDER BY round(gain, 6) DESC, query LIMIT 8",
    "iou_gain_curve": _sweep_ctes("p_a", SWEEP) + " SELECT query, document_id, threshold, round(iou, 6) AS iou, round(gain, 6) AS gain FROM g",
    "map_stats": f"{_BASE} SELECT query, count(*) AS cells, {_SHARES}, "
    + ", ".join(f"round(coalesce(quantile_cont(p_b, {p / 100}) FILTER (p_b > 0.5), 0), 6) AS q{p}" for p in (10, 25, 50, 75))
    + " FROM pixels GROUP BY query",
    "oracle_threshold_table": _sweep_ctes("p_b", SWEEP) + """ SELECT b.query, document_id, best_threshold, round(gain, 6) AS gain,
      round(default_iou, 6) AS default_iou, share_50, share_90 FROM best b JOIN (SELECT query,
      round(count(*) FILTER (p_b > 0.5) / CAST(count(*) AS DOUBLE), 6) AS share_50,
      round(count(*) FILTER (p_b > 0.9) / CAST(count(*) AS DOUBLE), 6) AS share_90 FROM pixels GROUP BY query) USING (query)
      WHERE gain >= 0.03""",
    "threshold_features": _sweep_ctes("p_b", SWEEP) + ", st AS (SELECT query, "
    + ", ".join(f"round(ln(count(*) FILTER (p_b > {t}) / CAST(count(*) AS DOUBLE) + 1e-6), 6) AS log_share_{int(round(t * 100)):02d}" for t in (0.1, 0.3, 0.5, 0.7, 0.9, 0.97)) + ", "
    + ", ".join(f"round(CASE WHEN count(*) FILTER (p_b > 0.3) > 2 THEN quantile_cont(p_b, {p / 100}) FILTER (p_b > 0.3) ELSE 0 END, 6) AS q{p}" for p in (10, 25, 50, 75))
    + """, round(avg(p_b) FILTER (quantity <= 20), 6) AS box_mean, round(quantile_cont(p_b, 0.1) FILTER (quantity <= 20), 6) AS box_p10,
      round(ln(count(*) FILTER (p_b > 0.3) / nullif(CAST(count(*) FILTER (quantity <= 20) AS DOUBLE), 0) + 1e-3), 6) AS log_area_ratio FROM pixels GROUP BY query)
      SELECT b.query, document_id, best_threshold, round(gain, 6) AS gain, st.* EXCLUDE (query) FROM best b JOIN st USING (query)""",
    "prediction_diff": f"{_BASE} SELECT query, count(*) AS changed FROM pixels WHERE (p_a > {CUT}) <> (p_b > {CUT}) GROUP BY query",
    "residual_stack": _sweep_ctes("p", SWEEP, f"""{_BASE}, lg AS (SELECT query, pos, least(greatest(p_a, 0.01), 0.99) AS a,
      least(greatest(p_b, 0.01), 0.99) AS b FROM pixels),
      st AS (SELECT query, pos, 1 / (1 + exp(-(ln(a / (1 - a)) + 0.5 * ln(b / (1 - b))))) AS p FROM lg)""", "st") + _SWEEP_OUT,
    "stored_logits": f"{_BASE} SELECT query, round(avg(1 / (1 + exp(-(p_a - 0.5) * 8))), 6) AS mean_p, "
    "round(max(1 / (1 + exp(-(p_a - 0.5) * 8))), 6) AS max_p FROM pixels GROUP BY query",
    "blend": f"{_BASE} SELECT query, count(*) AS cells, round(sum((p_a + p_b) / 2), 6) AS sum_p FROM "
    "(SELECT query, cell, max(p_a) AS p_a, max(p_b) AS p_b FROM pixels GROUP BY 1, 2) GROUP BY query",
    "paired_bootstrap": f"""{_DELTA}, n AS (SELECT count(*) AS n FROM delta),
      placed AS (SELECT row_number() OVER (ORDER BY document_id) - 1 AS i, delta FROM delta),
      mix AS (SELECT b, CAST('0x' || left(md5('0:' || b || ':' || i), 15) AS BIGINT) % n AS i
              FROM range(0, 5000) r(b), n, range(0, (SELECT n FROM n)) d(i)),
      means AS (SELECT b, avg(delta) AS m FROM mix JOIN placed USING (i) GROUP BY b)
      SELECT count(*) AS replicates, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM means""",
    "better_worse": f"{_DELTA} SELECT count(*) AS documents, round(avg(delta), 6) AS mean_delta, "
    "count(*) FILTER (round(delta, 9) > 0.005::DOUBLE) AS better, count(*) FILTER (round(delta, 9) < -0.005::DOUBLE) AS worse FROM delta",
    "fold_delta": f"{_DELTA} SELECT fold, count(*) AS documents, round(avg(delta), 6) AS mean_delta FROM delta JOIN folds USING (document_id) GROUP BY fold",
    "query_delta": f"""{_DELTA} SELECT query, round(a.iou, 6) AS base, round(b.iou, 6) AS candidate, round(b.iou - a.iou, 6) AS delta
      FROM (FROM ma WHERE iou IS NOT NULL) a FULL JOIN (FROM mb WHERE iou IS NOT NULL) b USING (query)
      WHERE a.iou IS NULL OR b.iou IS NULL OR abs(b.iou - a.iou) > 0.02""",
    "fold_score": _sweep_ctes("p_a", SWEEP) + f""", {_FOLDS}, w AS ({_SWEEP_OUT}), itall AS (SELECT * FROM it),
      part AS (SELECT threshold, round(avg(d), 6) AS doc_macro, round(sum(s) / sum(n), 6) AS query_mean
        FROM (SELECT threshold, document_id, avg(iou) AS d, sum(iou) AS s, count(*) AS n
              FROM itall SEMI JOIN (FROM folds WHERE fold = 0) USING (document_id) GROUP BY ALL) GROUP BY threshold)
      SELECT threshold, part.doc_macro, part.query_mean, w.doc_macro AS all_documents FROM part JOIN w USING (threshold)""",
    "label_conflict": f"{_BASE} SELECT count(*) AS pixels, count(DISTINCT query) AS queries, "
    "round(avg(CAST(pos AS DOUBLE)), 6) AS positive_share FROM pixels WHERE p_a > 0.75 AND p_b > 0.45",
    "feature_auc": f"{_BASE}, rows AS (SELECT query, pos, p_a, p_b, CASE WHEN p_b > 0.9 THEN NULL ELSE quantity END AS quantity FROM pixels) "
    + " UNION ALL ".join(_auc_sql(f) for f in ("p_a", "p_b", "quantity")) + " ORDER BY auc DESC, feature LIMIT 40",
    "expected_counts": f"""{_BASE} SELECT o_orderkey AS query, o_orderkey % 3 AS want_positive, o_orderkey % 5 AS want_negative,
      coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative FROM orders LEFT JOIN (
      SELECT query, count(*) FILTER (pos) AS positive, count(*) FILTER (NOT pos) AS negative FROM pixels GROUP BY query) ON query = o_orderkey
      WHERE coalesce(positive, 0) <> o_orderkey % 3 OR coalesce(negative, 0) <> o_orderkey % 5""",
    "missing_predictions": f"{_BASE} SELECT query FROM requests WHERE query NOT IN (SELECT query FROM pixels WHERE p_a > 0.95)",
    "incremental": f"{_BASE} SELECT query, document_id FROM requests WHERE query NOT IN (SELECT query FROM pixels WHERE p_b > {CUT})",
    "merge_check": f"""{_BASE}, a AS (SELECT query, avg(p_a) AS v, max(quantity) AS m FROM pixels WHERE p_b > 0.2 GROUP BY 1),
      b AS (SELECT query, avg(p_a) AS v, max(quantity) AS m FROM pixels WHERE p_b > 0.3 GROUP BY 1)
      SELECT query, CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' ELSE 'differs' END AS problem
      FROM a FULL JOIN b USING (query) WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > 1e-6 OR abs(a.m - b.m) > 1e-6""",
    "row_replay": f"""{_BASE}, a AS (SELECT query, pos, CAST(round(quantity) AS BIGINT) AS quantity FROM pixels WHERE p_a > 0.45),
      b AS (SELECT query, pos, CAST(round(quantity) AS BIGINT) AS quantity FROM pixels WHERE p_a > 0.55)
      SELECT *, 'only_a' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'only_b' AS side FROM (FROM b EXCEPT ALL FROM a)""",
    "nested_select": _sweep_ctes("p_a", SWEEP) + f""", {_FOLDS},
      dc AS (SELECT document_id, fold, 'c' || k AS candidate, avg(iou) AS score FROM it JOIN folds USING (document_id) GROUP BY ALL),
      inn AS (SELECT f.fold, candidate, avg(score) AS s FROM (SELECT DISTINCT fold FROM folds) f JOIN dc ON dc.fold <> f.fold GROUP BY ALL),
      pick AS (SELECT fold, candidate, s FROM inn QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(s, 9) DESC, candidate) = 1)
      SELECT fold, candidate, round(s, 6) AS inner_score, round((SELECT avg(score) FROM dc WHERE dc.fold = pick.fold AND
        dc.candidate = pick.candidate), 6) AS outer_score,
        (SELECT count(*) FROM dc WHERE dc.fold = pick.fold AND dc.candidate = pick.candidate) AS documents FROM pick""",
    "choose_threshold": _sweep_ctes("p_b", SWEEP) + f""" SELECT query, CASE WHEN gain > 0.05 THEN best_threshold ELSE {MIDDLE} END AS threshold,
      round(gain, 6) AS predicted_gain FROM best""",
}
