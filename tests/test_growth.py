"""What a task holds, reads or sends does not follow the largest group, value or table."""
import re

from pyspark.sql import functions as F

from regionmatch.operators import metrics, ordering


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sweep_sends_one_row_per_document(spark):
    rows = [("a", [0.5, None]), ("a", [1.0, 0.25]), ("b", [0.0, 1.0])]
    d = spark.createDataFrame(rows, "document_id string, ious array<double>")
    swept = metrics.threshold_sweep(d, (0.1, 0.2))
    assert not re.search(r"hashpartitioning\(document_id#\w+, _k", plan(swept))
    got = {r.threshold: (r.doc_macro, r.query_mean) for r in swept.collect()}
    assert got == {0.1: (0.375, 0.5), 0.2: (0.5625, 1.25 / 3)}
    assert metrics.threshold_sweep(d.limit(0), (0.1, 0.2)).isEmpty()


def test_quantiles_of_a_whole_table_do_not_deal_rows_by_bucket(spark):
    d = spark.range(1000).select(F.when(F.col("id") < 900, 0.5).otherwise(F.col("id") / 1000.0).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = ordering.exact_quantiles(d, [], "v", (0.0, 0.5, 0.95, 1.0), ordering.unit_bucket(F.col("_v")))
        assert "SortMergeJoin" not in plan(q)
        assert [round(v, 6) for v in q.first().quantiles] == [0.5, 0.5, 0.94905, 0.999]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_parts_of_a_fit_are_bounded_by_their_values(spark):
    from regionmatch.operators import models
    from regionmatch.session import cut_lineage

    rows = cut_lineage(spark.range(300_000).select(F.lit(0.5).alias("a"), F.lit(0.25).alias("b")))
    parts = models.spread(rows, 20_000).rdd.glom().map(len).collect()
    assert len(parts) == 30 and max(parts) < 11_000 and sum(parts) == 300_000
    assert models.spread(rows, 10**9).rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_auc_sends_rows_to_their_query_once_whatever_a_query_holds(spark):
    d = spark.range(4000).select(
        F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 40 + 1).alias("query"), (F.xxhash64("id") % 3 == 0).alias("pos"),
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) - 20.0).alias("f"), F.lit(None).cast("double").alias("g"))
    once, apart = metrics.feature_auc(d, ["f", "g"]), metrics.feature_auc(d, ["f", "g"], most=100)
    assert plan(once).count("Exchange") == 1
    assert sorted(once.collect()) == sorted(apart.collect())

    def brute(rows):
        v = [(r.pos, r.f) for r in rows]
        low = min(f for _, f in v if f is not None)
        p, n = ([low if f is None else f for b, f in v if b is k] for k in (True, False))
        a = sum((x > y) + (x == y) / 2 for x in p for y in n) / len(p) / len(n)
        return max(a, 1 - a)

    got = {r.query: r.auc for r in once.collect()}
    for q in (0, 1, 17):
        assert abs(got[q] - brute(d.filter(F.col("query") == q).collect())) < 1e-12


def test_cells_of_draws_are_numbered_at_their_query_whatever_it_holds(spark):
    from regionmatch.operators import sampling

    d = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 30 + 1).alias("query"),
                                 (F.col("id") % 3 == 0).alias("pos"), (F.col("id") % 700).cast("string").alias("cell"))
    whole, spread = sampling.numbered_cells(d), sampling.numbered_cells(d, most=100)
    assert plan(whole).count("Exchange") == 1
    assert sorted(whole.collect()) == sorted(spread.collect())
    rows = {(r.query, r.pos, r.cell) for r in d.collect()}
    sizes = {}
    for q, p, _ in rows:
        sizes[q, p] = sizes.get((q, p), 0) + 1
    got = {}
    for r in whole.collect():
        got.setdefault((r.query, r.pos), []).append(r.cell)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) for k, n in sizes.items()}


def test_rows_of_folds_are_joined_once_for_all_jobs_of_their_fits(spark):
    from regionmatch.operators import models

    d = spark.range(600).select("id", (F.col("id") % 6).alias("document_id"), (F.col("id") % 2 == 0).alias("pos"), F.lit(1.0).alias("weight"),
                                (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7 + F.col("id") % 2).cast("double").alias("f"))
    folds = d.select("document_id", (F.col("document_id") % 2).alias("fold")).distinct()
    o = models.out_of_fold(d, folds, lambda: models.logistic_head(["f"]), ["id"], 2)
    assert "Join" not in plan(o) and o.select("id").distinct().count() == o.count() == 600


def test_raster_rows_keep_their_parts_when_they_become_cells(spark):
    from regionmatch.plans import fixtures as fx

    px = fx.px(spark, "/root/testdata/sf0.001")
    assert px.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_tiles_are_packed_once_for_all_joins_that_read_them(spark):
    from regionmatch.operators import texture
    from regionmatch.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    px = fx.px(spark, sf)
    m = texture.correlate(px, texture.usable(texture.templates(px, fx.wide_boxes(spark, sf))), 61, tile=32, down=2)
    assert "FlatMapGroupsInArrow" not in plan(m)


def test_trees_of_equal_rows_are_those_of_all_rows(spark):
    from regionmatch.operators import models

    d = spark.range(4000).select(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(6)) / 6.0).alias(n) for k, n in enumerate("ab")], F.xxhash64("id").alias("_r"))
    d = d.select("a", "b", (F.col("a") * F.col("b") - F.when(F.col("a") > 0.4, 0.3).otherwise(0.1) + F.pmod("_r", F.lit(100)) / 500).alias("gain")).cache()
    few = models.equal_rows(d, ["a", "b"], "gain")
    assert few.count() == 36 and few.agg(F.sum("weight")).first()[0] == 4000
    for rows, least in ((d, 700), (d, 2000), (d.limit(70), 40)):
        n, small = rows.count(), models.equal_rows(rows, ["a", "b"], "gain")
        plain = models.gain_regressor(["a", "b"], rounds=6, min_rows=least).fit(rows)
        equal = models.gain_regressor(["a", "b"], rounds=6, min_rows=least, total=n).fit(small)
        both = equal.transform(few).select("a", "b", F.col("prediction").alias("p")).join(plain.transform(few), ["a", "b"])
        assert both.agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0] < 1e-9
        assert (plain.stages[-1].trees[0].numNodes > 1) == (least == 700)


def test_the_gain_model_takes_all_of_its_rounds(spark, monkeypatch):
    from regionmatch.operators import models
    from regionmatch.plans import learning

    made, whole = [], models.gain_regressor
    monkeypatch.setattr(models, "gain_regressor", lambda *a, **k: made.append(whole(*a, **k)) or whole(*a, **{**k, "rounds": 2}))
    got = learning.gain_model(spark, "/root/testdata/sf0.001")
    assert [p.getStages()[-1].getMaxIter() for p in made] == [150] and not got.isEmpty()


def test_feature_rows_write_narrow_families_and_drop_the_maps(spark, monkeypatch):
    import os

    from regionmatch import session
    from regionmatch.plans import end_to_end as e, fixtures as fx

    sf, wide, write = "/root/testdata/sf0.001", [], session.cut_lineage
    px, b = write(fx.px(spark, sf).filter("image < 2")), fx.boxes(spark, sf).filter("image < 2")
    pts = e.grid_points(px, b)
    made, before = [], len(session._WRITTEN)

    def noted(df):
        out = write(df)
        wide.append(len(df.columns))
        made.append(session._WRITTEN[-1].removeprefix("file://"))
        return out

    for owner in (session, e):
        monkeypatch.setattr(owner, "cut_lineage", noted)
    rows = e.feature_rows(px, [], b, pts, spectrum=(), blob_radii=(2,))
    names = [n for n in rows.columns if n not in pts.columns]
    assert len(names) == len(set(names)) > 80 and max(wide) < 40
    left = {p.removeprefix("file://") for p in session._WRITTEN[before:]}
    assert len(left) < len(made) and {p for p in made if os.path.exists(p)} <= left
    assert rows.count() == pts.count() > 0
    r = rows.select("mean4", "q_mean4", "mean4_d", "mean4_ad").first()
    assert r.mean4_d == r.mean4 - r.q_mean4 and r.mean4_ad == abs(r.mean4_d)


def test_tables_on_the_way_go_with_their_shuffle_files(spark):
    import os

    from regionmatch import session

    seen = []

    def build():
        a = session.cut_lineage(spark.range(100).repartition(3))
        seen.append(session._WRITTEN[-1])
        return [a.groupBy((F.col("id") % 7).alias("k")).count(), a.filter("id < 5")]

    sums, few = session.settled(spark, build)
    assert not os.path.exists(seen[0].removeprefix("file://")) and seen[0] not in session._WRITTEN
    assert (sums.count(), few.count()) == (7, 5)
    assert spark.conf.get(session._CLEANUP, None) in (None, "false")
