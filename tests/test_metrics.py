import pytest
from pyspark.sql import functions as F

from regionmatch.operators import compare, metrics, sampling, selection

COLS = "query string, document_id string, tp long, fp long, fn long, tn long, blank_fp long, blank_pixels long"


def test_document_macro_and_pooled_rates(spark):
    rows = [("1", "a", 1, 0, 0, 1, 0, 0), ("2", "a", 9, 0, 0, 1, 0, 0), ("3", "b", 0, 0, 100, 1, 0, 0), ("4", "c", 0, 2, 0, 8, 0, 0)]
    m = metrics.query_metrics(spark.createDataFrame(rows, COLS))
    s = metrics.summary(m).first()
    assert s["document_macro_iou"] == 0.5
    assert s["mean_query_iou"] == pytest.approx(2 / 3)
    assert s["global_precision"] == pytest.approx(10 / 12)
    assert s["global_recall"] == pytest.approx(10 / 110)
    assert s["empty_target_false_positive_rate"] == pytest.approx(0.2)
    assert (s["documents"], s["nonempty_target_examples"], s["empty_target_examples"]) == (3, 3, 1)
    assert {r["document_id"] for r in metrics.per_document(m).collect()} == {"a", "b"}


def test_empty_target_is_undefined(spark):
    r = metrics.query_metrics(spark.createDataFrame([("1", "a", 0, 0, 0, 5, 0, 0)], COLS)).first()
    assert r["iou"] is None and r["precision"] is None and r["recall"] is None
    assert r["blank_false_positive_rate"] is None and r["empty_target_false_positive_rate"] == 0


def test_blank_rates_and_count_contract(spark):
    rows = [("ok", "a", 2, 3, 1, 9, 1, 4), ("none", "a", 0, 0, 0, 0, 0, 0), ("neg", "a", 1, -1, 0, 0, 0, 0), ("sub", "a", 1, 0, 0, 0, 1, 1)]
    df = spark.createDataFrame(rows, COLS)
    ok = metrics.query_metrics(df.filter("query = 'ok'")).first()
    assert ok["blank_false_positive_rate"] == 0.25 and ok["iou"] == pytest.approx(2 / 6)
    bad = {r["query"]: r["rule"] for r in metrics.count_violations(df).collect()}
    assert bad == {"none": "empty_domain", "neg": "negative_count", "sub": "blank_not_subset"}


def test_dev_score_has_no_nulls_for_zero_denominators(spark):
    r = metrics.dev_score(spark.createDataFrame([("1", "a", 0, 0, 3, 1, 0, 0)], COLS)).first()
    assert r["precision"] == 0 and r["recall"] == 0


def test_masks_shrink_with_the_threshold(spark):
    d = spark.range(300).select((F.col("id") % 3).alias("query"), (F.col("id") % 2 == 0).alias("pos"), ((F.col("id") * 37 % 101) / 100).alias("p"))
    for r in metrics.threshold_counts(d, "p", (0.1, 0.5, 0.9), ["query"]).collect():
        assert r["tp"] == sorted(r["tp"], reverse=True) and r["fp"] == sorted(r["fp"], reverse=True)


def test_auc_merges_undefined_with_the_minimum(spark):
    rows = [(1, True, 3.0), (1, True, None), (1, False, 1.0), (1, False, 2.0), (2, True, 1.0)]
    d = spark.createDataFrame(rows, "query int, pos boolean, f double")
    out = metrics.feature_auc(d, ["f"]).collect()
    # query 1: values 3, 1 against 1, 2 -> 2 wins, half a tie, one loss
    assert [(r["query"], r["auc"]) for r in out] == [(1, 0.625)]


def test_bootstrap_interval_covers_a_constant_delta(spark):
    d = spark.range(20).select(F.col("id").alias("document_id"), F.lit(0.25).alias("delta"))
    m = compare.bootstrap_means(d, "document_id", F.floor(F.col("document_id") / 4).cast("long"), 200)
    r = compare.bootstrap_interval(m).first()
    assert (r["replicates"], r["lo"], r["hi"]) == (200, 0.25, 0.25)


def test_folds_are_disjoint_and_even(spark):
    docs = spark.range(103).select(F.col("id").alias("document_id"))
    folds = sampling.document_folds(docs, 4).collect()
    assert len(folds) == 103 == len({r["document_id"] for r in folds})
    sizes = [sum(r["fold"] == k for r in folds) for k in range(4)]
    assert max(sizes) - min(sizes) <= 1


def test_weights_sum_to_the_totals(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("query"), (F.col("id") % 5 == 0).alias("pos"))
    totals = spark.range(7).select(F.col("id").alias("query"), F.lit(2.0).alias("total"))
    w = sampling.spread_weights(rows, totals, True).groupBy("query", "pos").agg(F.sum("weight").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in w)
    mean = sampling.inverse_size_weights(rows).agg(F.avg("weight")).first()[0]
    assert mean == pytest.approx(1.0)


def test_margin_keeps_the_default(spark):
    c = spark.createDataFrame([(1, 0.4, 0.2), (1, 0.5, 0.0), (2, 0.4, 0.01), (2, 0.5, 0.0)], "query int, threshold double, gain double")
    got = {r["query"]: r["threshold"] for r in selection.choose_with_margin(c, "gain", 0.5, 0.05).collect()}
    assert got == {1: 0.4, 2: 0.5}
