"""Queries that fit models or verify components."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionmatch.functions.scalars import logit
from regionmatch.operators import metrics, models, sampling, selection, verify
from regionmatch.operators.ordering import unit_bucket
from regionmatch.plans import fixtures as fx
from regionmatch.plans.scoring import SWEEP, MIDDLE, _ious
from regionmatch.session import cut_lineage

FEATURES = ["f_chars", "f_words", "f_lines", "f_digits", "f_upper"]


def _rows(spark, sf):
    """Labelled rows, weighted so that every document group counts the same."""
    t = fx.text_rows(spark, sf).withColumn("label", F.col("pos").cast("double"))
    w = sampling.inverse_size_weights(t.withColumn("query", F.col("document_id"))).drop("query")
    return cut_lineage(w)  # several fits read it


def _small_head(seed=0):
    return models.boosted_head(FEATURES, rounds=5, depth=3, min_rows=5, seed=seed)


def _folds(rows, k=2):
    return sampling.document_folds(rows, k)


def boosted_out_of_fold(spark, sf):
    r = _rows(spark, sf)
    o = models.out_of_fold(r, _folds(r), _small_head, ["doc_id", "document_id", "pos"], 2)
    return o.withColumn("p", F.round("p", 6))


def logistic_out_of_fold(spark, sf):
    r = _rows(spark, sf)
    o = models.out_of_fold(r, _folds(r), lambda: models.logistic_head(FEATURES), ["doc_id", "document_id", "pos"], 2)
    return o.withColumn("p", F.round("p", 4))


def seed_bag(spark, sf):
    r = _rows(spark, sf)
    return models.seed_bag(r, r, _small_head, (0, 1), ["doc_id"]).withColumn("p", F.round("p", 6))


def stacked_head(spark, sf):
    """A second model gets the first one's out-of-fold logit as one more column."""
    r = _rows(spark, sf)
    first = models.out_of_fold(r, _folds(r), lambda: models.logistic_head(FEATURES), ["doc_id"], 2)
    r2 = cut_lineage(r.join(first.select("doc_id", logit(F.col("p")).alias("first_logit")), "doc_id"))
    make = lambda: models.boosted_head([*FEATURES, "first_logit"], rounds=5, depth=3, min_rows=5)
    return models.out_of_fold(r2, _folds(r2), make, ["doc_id", "pos"], 2).withColumn("p", F.round("p", 6))


def mined_head(spark, sf):
    """Refit with the negatives that an out-of-fold model scores high."""
    r = _rows(spark, sf)
    o = models.out_of_fold(r, _folds(r), lambda: models.logistic_head(FEATURES), ["doc_id"], 2).select("doc_id", "p")
    pool = r.join(o, "doc_id").withColumn("query", F.col("document_id"))
    totals = pool.select("query").distinct().withColumn("total", F.lit(1.0))
    mined = sampling.hard_negatives(pool.drop("weight"), "p", 0.5, totals, 0.5)
    train = cut_lineage(r.unionByName(mined.select(*r.columns)))
    m = _small_head().fit(train)
    return models.score(m, r, ["doc_id"]).withColumn("p", F.round("p", 6))


def ablation(spark, sf):
    """Feature families left out one at a time, same folds, scored against the full set."""
    r = _rows(spark, sf)
    folds = _folds(r)
    out = None
    for name, feats in (("all", FEATURES), ("no_size", FEATURES[2:]), ("no_share", FEATURES[:3])):
        o = models.out_of_fold(r, folds, lambda: models.logistic_head(feats), ["document_id", "pos"], 2)
        c = metrics.threshold_counts(o, "p", (0.4, 0.5, 0.6), ["document_id"]).withColumn("query", F.col("document_id"))
        s = metrics.threshold_sweep(metrics.threshold_ious(c), (0.4, 0.5, 0.6)).select(
            F.lit(name).alias("configuration"), "threshold", F.round("doc_macro", 3).alias("doc_macro"))
        out = s if out is None else out.unionByName(s)
    return out


def gain_model(spark, sf):
    """Predict each query's IoU gain per threshold from label-free statistics; choose with a margin."""
    curve = metrics.iou_gain_curve(_ious(spark, sf, SWEEP), SWEEP, MIDDLE)
    stats = metrics.accepted_stats(fx.pixels(spark, sf), "p_a", (0.1, 0.3, 0.5, 0.7, 0.9))
    shares = [c for c in stats.columns if c.startswith("share_")]
    rows = cut_lineage(curve.join(stats, "query"))
    names = [*shares, "threshold"]
    few = cut_lineage(models.equal_rows(rows, names, "gain"))
    m = models.gain_regressor(names, total=rows.count()).fit(models.spread(few))
    pred = m.transform(rows).select("query", "threshold", F.col("prediction").alias("predicted"))
    return selection.choose_with_margin(pred, "predicted", MIDDLE, 0.02).withColumn("predicted_gain", F.round("predicted_gain", 6))


def whitened_vectors(spark, sf):
    """Vectors on sixteen whitened principal axes, fitted on all of them."""
    g = fx.grid_vectors(spark, sf)
    p = models.whitening(g, "vec", 16)(g)
    return p.select("image", "gy", "gx", *[F.round(F.abs(F.col("projected")[i]), 4).alias(f"a{i}") for i in range(3)])


def channel_moments(spark, sf):
    """Mean and deviation of each channel, and the table standardized by them."""
    r = fx.pixels(spark, sf)
    m = models.moments(r, ["p_a", "p_b", "quantity"])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


# ---- component verification -------------------------------------------------------------


def _accepted(spark, sf):
    """Points attributed to components: the part of a pixel's line number, inside accepted pixels."""
    li = fx.pixels(spark, sf).withColumn("k", F.floor("quantity").cast("int"))
    return li.select("query", "pos", "p_a", "p_b", F.when(F.col("p_a") > 0.35, F.col("k") % 3).alias("comp"))


def _tables(spark, sf):
    pts = _accepted(spark, sf)
    docs = fx.requests(spark, sf).select("query", "document_id")
    base = metrics.confusion(pts.withColumn("blank", F.lit(False)), F.col("comp").isNotNull()).select("query", "tp", "fp", "fn")
    comps = pts.filter("comp is not null").groupBy("query", "comp").agg(
        F.count("*").alias("tot"), F.count_if("pos").alias("pos"), F.avg("p_b").alias("score"),
        F.max("p_a").alias("peak"))
    return cut_lineage(comps.withColumn("is_query", F.col("comp") == 0)), base, docs


def component_labels(spark, sf):
    return verify.label_counts(_accepted(spark, sf))


def component_gain(spark, sf):
    c, base, _ = _tables(spark, sf)
    return verify.with_gain(c, base).select("query", "comp", "tot", "pos", F.round("purity", 6).alias("purity"), F.round("gain", 6).alias("gain"))


def component_oracle(spark, sf):
    """Score when every majority-negative component is dropped, next to the base score."""
    c, base, docs = _tables(spark, sf)
    after = verify.drop_and_score(base, verify.majority_wrong(c))
    out = None
    for name, t in (("base", base), ("oracle", after)):
        s = metrics.dev_score(t.join(docs, "query")).select(F.lit(name).alias("variant"), *[F.round(n, 6).alias(n) for n in ("doc_macro", "query_mean", "precision", "recall")])
        out = s if out is None else out.unionByName(s)
    return out


def component_relative(spark, sf):
    c, _, _ = _tables(spark, sf)
    r = verify.within_query(c, ["score", "peak"])
    return r.select("query", "comp", *[F.round(n, 6).alias(n) for n in ("rmax_score", "rq_score", "rmax_peak", "rq_peak")])


def verifier_weights(spark, sf):
    c, base, docs = _tables(spark, sf)
    g = verify.with_gain(c, base)
    out = None
    for target in ("gain", "gaincap", "purity"):
        w = verify.verifier_rows(g, docs, target).select(F.lit(target).alias("target"), "query", "comp", "label", F.round("weight", 9).alias("weight"))
        out = w if out is None else out.unionByName(w)
    return out


def verifier_model(spark, sf):
    """Logistic verifier on component features; drops those below a keep probability and re-scores."""
    c, base, docs = _tables(spark, sf)
    rows = cut_lineage(verify.verifier_rows(verify.with_gain(c, base), docs))
    m = models.logistic_head(["score", "peak"]).fit(rows)
    kept = models.score(m, rows, ["query", "comp", "tot", "pos"])
    after = verify.drop_and_score(base, kept.filter("p < 0.4"))
    return metrics.dev_score(after.join(docs, "query")).select(*[F.round(n, 4).alias(n) for n in ("doc_macro", "query_mean", "precision", "recall")])


LEVELS = tuple(0.02 + 0.04 * i for i in range(13))


def cut_rule(spark, sf):
    """Single-feature drop rule: cut picked on the other folds, scored on the held-out one."""
    c, base, docs = _tables(spark, sf)
    cuts = cut_lineage(verify.cut_candidates(c, "score", LEVELS, unit_bucket(F.col("_v"))))
    s = verify.cut_scores(c.filter(~F.col("is_query")), base, docs, "score", cuts, low=True)
    folds = sampling.document_folds(fx.requests(spark, sf), 4)
    long = s.join(folds, "document_id").select("document_id", "fold", F.format_string("%.6f", "cut").alias("candidate"), "score")
    return selection.nested_choice(long).withColumns({n: F.round(n, 6) for n in ("inner_score", "outer_score")})


HIGH = tuple(0.02 + 0.08 * i for i in range(13))


def cut_rules(spark, sf):
    """Drop rules of two features on either side: cut picked on the other folds, scored on the held-out one."""
    c, base, docs = _tables(spark, sf)
    s = verify.rule_scores(c.filter(~F.col("is_query")), base, docs, ["score", "peak"], LEVELS, HIGH)
    long = s.join(sampling.document_folds(fx.requests(spark, sf), 4), "document_id")
    name = F.coalesce(F.format_string("%.6f", "cut"), F.lit("none"))
    picked = selection.nested_choice(long.select("document_id", "fold", "feature", "side", name.alias("candidate"), "score"), ["feature", "side"])
    return picked.withColumns({n: F.round(n, 6) for n in ("inner_score", "outer_score")})


def ablation_delta(spark, sf):
    """Each ablation against the full set on the same documents: mean difference, documents better and worse."""
    from regionmatch.operators import compare

    r = _rows(spark, sf)
    folds, ious = _folds(r), {}
    for name, feats in (("all", FEATURES), ("no_size", FEATURES[2:]), ("no_share", FEATURES[:3])):
        o = models.out_of_fold(r, folds, lambda: models.logistic_head(feats), ["document_id", "pos"], 2)
        c = metrics.threshold_counts(o, "p", (0.5,), ["document_id"]).withColumn("query", F.col("document_id"))
        ious[name] = cut_lineage(metrics.threshold_ious(c).select("document_id", F.col("ious")[0].alias("document_iou")))
    out = None
    for name in ("no_size", "no_share"):
        s = compare.better_worse(compare.document_delta(ious["all"], ious[name]), 1e-9).select(F.lit(name).alias("configuration"), "documents", F.round("mean_delta", 3).alias("mean_delta"), "better", "worse")
        out = s if out is None else out.unionByName(s)
    return out


QUERIES = {f.__name__: f for f in (
    boosted_out_of_fold, logistic_out_of_fold, seed_bag, stacked_head, mined_head, ablation, gain_model, whitened_vectors,
    channel_moments, component_labels, component_gain, component_oracle, component_relative, verifier_weights,
    verifier_model, cut_rule, cut_rules, ablation_delta)}


_BASE = f"""WITH {fx.PIXELS}, {fx.REQUESTS},
  pts AS (SELECT query, pos, p_a, p_b, CASE WHEN p_a > 0.35 THEN CAST(floor(quantity) AS INT) % 3 END AS comp FROM pixels),
  base AS (SELECT query, count(*) FILTER (comp IS NOT NULL AND pos) AS tp, count(*) FILTER (comp IS NOT NULL AND NOT pos) AS fp,
    count(*) FILTER (comp IS NULL AND pos) AS fn FROM pts GROUP BY query),
  cm AS (SELECT query, comp, count(*) AS tot, count(*) FILTER (pos) AS pos, avg(p_b) AS score, max(p_a) AS peak FROM pts WHERE comp IS NOT NULL GROUP BY ALL),
  gn AS (SELECT cm.*, pos / CAST(tot AS DOUBLE) AS purity, (tp - pos) / CAST(nullif(tp + fp + fn - (tot - pos), 0) AS DOUBLE) - tp / CAST(tp + fp + fn AS DOUBLE) AS gain
    FROM cm JOIN base USING (query) WHERE tp + fn > 0),
  shr AS (SELECT document_id, 1.0::DOUBLE / count(*) AS w FROM requests GROUP BY 1),
  gw AS (SELECT gn.*, w, avg(tot) OVER () AS mt FROM gn JOIN requests USING (query) JOIN shr USING (document_id))"""


def _dev(src, name):
    return f"""SELECT '{name}' AS variant, (SELECT round(avg(v), 6) FROM (SELECT avg(tp / CAST(tp + fp + fn AS DOUBLE)) AS v FROM {src} JOIN requests USING (query) WHERE tp + fn > 0 GROUP BY document_id)) AS doc_macro,
      round(avg(tp / CAST(tp + fp + fn AS DOUBLE)) FILTER (tp + fn > 0), 6) AS query_mean, round(sum(tp) / CAST(sum(tp + fp) AS DOUBLE), 6) AS precision,
      round(sum(tp) / CAST(sum(tp + fn) AS DOUBLE), 6) AS recall FROM {src}"""


ORACLE = {
    "channel_moments": f"WITH {fx.PIXELS} SELECT " + ", ".join(
        f"round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}) + 1e-3, 6) AS std_{c}" for c in ("p_a", "p_b", "quantity")) + " FROM pixels",
    "component_labels": f"{_BASE} SELECT query, comp, tot, pos FROM cm",
    "component_gain": f"{_BASE} SELECT query, comp, tot, pos, round(purity, 6) AS purity, round(gain, 6) AS gain FROM gn",
    "component_oracle": f"""{_BASE}, dr AS (SELECT query, sum(pos) AS p, sum(tot - pos) AS n FROM cm WHERE 2 * pos < tot GROUP BY query),
      af AS (SELECT query, tp - coalesce(p, 0) AS tp, fp - coalesce(n, 0) AS fp, fn + coalesce(p, 0) AS fn FROM base LEFT JOIN dr USING (query))
      {_dev('base', 'base')} UNION ALL {_dev('af', 'oracle')}""",
    "component_relative": f"""{_BASE} SELECT query, comp, round(score - max(score) OVER w, 6) AS rmax_score, round(score - max(score) FILTER (comp = 0) OVER w, 6) AS rq_score,
      round(peak - max(peak) OVER w, 6) AS rmax_peak, round(peak - max(peak) FILTER (comp = 0) OVER w, 6) AS rq_peak FROM cm WINDOW w AS (PARTITION BY query)""",
    "verifier_weights": f"""{_BASE} SELECT 'gain' AS target, query, comp, CAST(gain <= 0 AS DOUBLE) AS label, round(abs(gain) * w + 1e-6, 9) AS weight FROM gw
      UNION ALL SELECT 'gaincap', query, comp, CAST(gain <= 0 AS DOUBLE), round(least(abs(gain), 0.1) * w + 1e-6, 9) FROM gw
      UNION ALL SELECT 'purity', query, comp, CAST(purity >= 0.5 AS DOUBLE), round(w * least(tot / mt, 10), 9) FROM gw""",
    "cut_rules": f"""{_BASE}, lg AS (SELECT query, comp, pos, tot, unnest(['score', 'peak']) AS feature, unnest([score, CAST(peak AS DOUBLE)]) AS value FROM cm WHERE comp <> 0),
      cuts AS (SELECT DISTINCT feature, 'low' AS side, unnest(quantile_cont(value, [{", ".join(f"{v!r}::DOUBLE" for v in LEVELS)}])) AS cut FROM lg GROUP BY feature
        UNION SELECT feature, 'high', unnest(quantile_cont(value, [{", ".join(f"{v!r}::DOUBLE" for v in HIGH)}])) FROM lg GROUP BY feature),
      alls AS (SELECT * FROM cuts UNION ALL SELECT DISTINCT feature, side, NULL FROM cuts),
      ch AS (SELECT query, feature, side, cut, sum(pos) AS p, sum(tot - pos) AS n FROM lg JOIN cuts USING (feature) WHERE CASE side WHEN 'low' THEN value < cut ELSE value > cut END GROUP BY ALL),
      dc AS (SELECT document_id, a.feature, a.side, coalesce(printf('%.6f', a.cut), 'none') AS candidate, avg((tp - coalesce(p, 0)) / CAST(tp + fn + fp - coalesce(n, 0) AS DOUBLE)) AS score
        FROM (SELECT * FROM base, alls WHERE tp + fn > 0) a LEFT JOIN ch ON ch.query = a.query AND ch.feature = a.feature AND ch.side = a.side AND ch.cut = a.cut JOIN requests r ON r.query = a.query GROUP BY ALL),
      folds AS (SELECT document_id, (row_number() OVER (ORDER BY md5('0:' || document_id), document_id) - 1) % 4 AS fold FROM (SELECT DISTINCT document_id FROM requests)),
      df AS (SELECT fold, feature, side, candidate, score FROM dc JOIN folds USING (document_id)),
      inn AS (SELECT f.fold, feature, side, candidate, avg(score) AS s FROM (SELECT DISTINCT fold FROM folds) f JOIN df ON df.fold <> f.fold GROUP BY ALL),
      pick AS (SELECT * FROM inn QUALIFY row_number() OVER (PARTITION BY fold, feature, side ORDER BY round(s, 9) DESC, candidate) = 1)
      SELECT pick.feature, pick.side, pick.fold, pick.candidate, round(any_value(s), 6) AS inner_score, round(avg(score), 6) AS outer_score, count(*) AS documents
      FROM pick JOIN df ON df.fold = pick.fold AND df.feature = pick.feature AND df.side = pick.side AND df.candidate = pick.candidate GROUP BY ALL""",
    "cut_rule": f"""{_BASE}, cuts AS (SELECT DISTINCT unnest(quantile_cont(score, [{", ".join(f"{v!r}::DOUBLE" for v in LEVELS)}])) AS cut FROM cm UNION ALL SELECT '-inf'::DOUBLE),
      ch AS (SELECT query, cut, sum(pos) AS p, sum(tot - pos) AS n FROM cm, cuts WHERE comp <> 0 AND score < cut GROUP BY ALL),
      dc AS (SELECT document_id, printf('%.6f', cut) AS candidate, avg((tp - coalesce(p, 0)) / CAST(tp + fn + fp - coalesce(n, 0) AS DOUBLE)) AS score
        FROM (SELECT * FROM base, cuts WHERE tp + fn > 0) LEFT JOIN ch USING (query, cut) JOIN requests USING (query) GROUP BY ALL),
      folds AS (SELECT document_id, (row_number() OVER (ORDER BY md5('0:' || document_id), document_id) - 1) % 4 AS fold FROM (SELECT DISTINCT document_id FROM requests)),
      df AS (SELECT fold, CASE candidate WHEN '-inf' THEN '-Infinity' ELSE candidate END AS candidate, score FROM dc JOIN folds USING (document_id)),
      inn AS (SELECT f.fold, candidate, avg(score) AS s FROM (SELECT DISTINCT fold FROM folds) f JOIN df ON df.fold <> f.fold GROUP BY ALL),
      pick AS (SELECT fold, candidate, s FROM inn QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(s, 9) DESC, candidate) = 1)
      SELECT fold, candidate, round(s, 6) AS inner_score, round((SELECT avg(score) FROM df WHERE df.fold = pick.fold AND df.candidate = pick.candidate), 6) AS outer_score,
        (SELECT count(*) FROM df WHERE df.fold = pick.fold AND df.candidate = pick.candidate) AS documents FROM pick""",
}
