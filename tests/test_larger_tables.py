"""Queries against their SQL twins where sums end on a cut or tables outgrow the smallest ones."""
from pathlib import Path

import pytest
from check_queries import TABLES, compare as against_sql, connect
from pyspark.sql import Window as W, functions as F

from regionmatch.operators import compare
from regionmatch.plans import registry

SMALL = Path("/root/testdata/sf0.001")


def tables(folder, **changed):
    """The smallest tables in a new folder, some of them replaced by given rows."""
    for name in TABLES:
        if name in changed:
            changed[name].toPandas().to_parquet(folder / f"{name}.parquet", coerce_timestamps="us")
        else:
            (folder / f"{name}.parquet").symlink_to(SMALL / f"{name}.parquet")
    return str(folder)


def equals_sql(spark, name, sf):
    result, _, _ = against_sql(spark, connect(sf), registry.QUERIES[name], registry.ORACLE[name], sf)
    return result


def one_image(spark, rows):
    """Vectors of one image of the given height."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").limit(500)
    more = e.crossJoin(spark.range(-(-rows // 500)).select(F.col("id").alias("i"))).withColumn("vec_id", F.col("vec_id") + 500 * F.col("i"))
    return more.filter(F.col("vec_id") < rows).select("vec_id", "embedding", F.lit(0).alias("label"))


def test_a_delta_of_exactly_the_margin_is_neither_better_nor_worse(spark):
    d = spark.createDataFrame([(0.0050000000000000044,), (-0.00500000000000006,), (0.0050001,), (-0.0050001,)], "delta double")
    assert tuple(compare.better_worse(d, 0.005).select("documents", "better", "worse").first()) == (4, 1, 1)


def test_an_average_on_the_cut_does_not_depend_on_the_order_of_its_sum(spark, tmp_path):
    li = spark.read.parquet(str(SMALL / "lineitem.parquet")).limit(4)
    # in any order 0, 0.4, 0.4 and 0.4 sum to a little over 1.2, whose quarter is not above the cut of 0.3
    li = li.withColumn("l_orderkey", F.lit(1).cast("long")).withColumn("n", F.row_number().over(W.orderBy("l_linenumber", "l_partkey")))
    li = li.withColumn("l_discount", F.when(F.col("n") == 1, 0.0).otherwise(0.04)).withColumn("l_tax", F.lit(0.02)).drop("n")
    sf = tables(tmp_path, lineitem=li)
    row = registry.QUERIES["derived_evidence"](spark, sf).first()
    assert row["ev_min1"] != 0.3 and equals_sql(spark, "derived_evidence", sf) == "ok 1"


def test_regridded_labels_of_a_tall_raster(spark, tmp_path):
    assert equals_sql(spark, "regrid_labels", tables(tmp_path, embeddings=one_image(spark, 2900))) == f"ok {208 * 5}"


def test_spectra_of_a_tall_raster(spark, tmp_path):
    assert equals_sql(spark, "spectra", tables(tmp_path, embeddings=one_image(spark, 450))) == f"ok {113 * 16}"


def test_tone_cuts_see_exact_means(spark):
    from regionmatch.plans import descriptors, fixtures as fx

    sf = "/root/testdata/sf0.1"
    whole = fx.px(spark, sf).groupBy("image", F.floor(F.col("y") / 4).alias("y"), F.floor(F.col("x") / 4).alias("x")).agg(F.sum("gray").alias("s"), F.count("*").alias("n"))
    both = descriptors._tone(spark, sf).join(whole, ["image", "y", "x"])
    assert both.filter(F.col("paper4") != F.expr("(s * 8) div (n * 255)") / 8).isEmpty()


def test_a_resample_draws_as_many_documents_as_there_are(spark, monkeypatch):
    import hashlib

    n, replicates = 23, 7
    rows = [(i, None if i == 5 else (i * 37 % 23) / 8) for i in range(n)]
    delta = [v for _, v in rows]
    want = {}
    for b in range(replicates):
        drawn = [delta[int(hashlib.md5(f"0:{b}:{i}".encode()).hexdigest()[:15], 16) % n] for i in range(n)]
        kept = [v for v in drawn if v is not None]
        want[b] = sum(kept) / len(kept)
    d = spark.createDataFrame(rows, "document_id long, delta double")
    for piece, pieces in ((1 << 20, 8), (5, 2)):  # all in one part, and in several
        monkeypatch.setattr(compare, "PIECE", piece)
        monkeypatch.setattr(compare, "PIECES", pieces)
        got = {r.replicate: r.mean_delta for r in compare.bootstrap_means(d, "document_id", replicates=replicates).collect()}
        assert got == pytest.approx(want, abs=1e-12)


def test_the_sweep_of_edits_joins_no_cells(spark):
    import re

    plan = registry.QUERIES["post_process_sweep"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[query#\w+, y#\w+, x#\w+", plan)


@pytest.mark.parametrize("name", ["region_runs", "cell_fractions", "cell_iou", "run_confusion", "domain_violations", "known_pixels"])
def test_shapes_are_exchanged_once_and_runs_never(spark, name):
    plan = registry.QUERIES[name](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    # the shapes, and the one row a query has when it is joined to the requests
    assert plan.count("Exchange hashpartitioning") <= (2 if name == "domain_violations" else 1)


def test_drop_rules_become_rows_only_at_their_document(spark):
    import re

    plan = registry.QUERIES["cut_rules"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "document_id" in plan and not re.search(r"hashpartitioning\(document_id#\w+, feature#\w+, side#\w+, cut#", plan)
