"""Draws, resamples and scratch folders."""
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from regionmatch.functions.scalars import draw
from regionmatch.operators import sampling
from regionmatch.operators.compare import bootstrap_interval, bootstrap_means, resample_count

ROOT = Path(__file__).resolve().parents[1]


def test_draws_reach_every_index_evenly(spark):
    d = spark.range(400_000).select(draw(3, F.col("id"), F.lit(1), F.lit(200_000)).alias("i")).agg(F.max("i"), F.min("i"), F.countDistinct("i")).first()
    assert d[0] > 199_900 and d[1] < 100 and d[2] > 170_000
    halves = spark.range(2_000_000).select(draw(0, F.col("id"), F.lit(0), F.lit(10_000)).alias("i")).agg(
        F.avg((F.col("i") < 5536).cast("double"))).first()[0]
    assert abs(halves / 0.5536 - 1) < 0.01


def test_bootstrap_of_constant_deltas(spark):
    deltas = spark.range(50).select(F.col("id").alias("document_id"), F.lit(0.25).alias("delta"))
    rows = bootstrap_means(deltas, "document_id", replicates=40).collect()
    assert len(rows) == 40 and all(r.mean_delta == 0.25 for r in rows)


def test_resample_counts_are_even_and_independent(spark):
    n = spark.range(400).crossJoin(spark.range(500).select(F.col("id").alias("b"))).select("id", "b", resample_count(F.col("id"), F.col("b")).alias("n")).toPandas()
    counts = n.pivot(index="id", columns="b", values="n").to_numpy().astype(float)
    for k, share in enumerate((0.3679, 0.3679, 0.1839, 0.0613, 0.0153)):
        assert abs((counts == k).mean() - share) < 0.004
    assert abs(counts.var() - 1) < 0.02 and abs(counts.mean() - 1) < 0.01
    for a, b in ((counts[1:], counts[:-1]), (counts[:, 1:], counts[:, :-1]), (counts[2:, 1:], counts[:-2, :-1])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.01
    # sums of a replicate vary as draws do, so no replicate favours some documents
    assert abs(counts.sum(0).std() / 20 - 1) < 0.12 and abs(counts.sum(1).std() / 500**0.5 - 1) < 0.12


def test_bootstrap_interval_is_that_of_plain_resampling(spark):
    rng = np.random.default_rng(0)
    delta = rng.normal(0.1, 1, 400)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(delta)], "document_id long, delta double")
    got = bootstrap_interval(bootstrap_means(rows, "document_id", replicates=4000)).first()
    want = np.percentile(delta[rng.integers(400, size=(4000, 400))].mean(1), (2.5, 97.5))
    assert abs(got.lo - want[0]) < 0.01 and abs(got.hi - want[1]) < 0.01


def test_absent_kind_leaves_no_gap(spark):
    cells = spark.createDataFrame([("real", d, q, p, c) for d in range(3) for q in (2 * d, 2 * d + 1) for p in (True, False) for c in range(4)],
                                  "kind string, document_id int, query int, pos boolean, cell long")
    assert sampling.two_stage_draws(cells, 200, 0.3).count() == 200


def test_cut_lineage_with_an_empty_configuration_and_from_another_folder(tmp_path):
    """Kernels and scratch tables work where no Spark configuration is set and the folder is not the repository's."""
    code = """
from regionmatch.session import build_session, cut_lineage, drop_written, scratch_root
s = build_session("local[2]", 2)
assert cut_lineage(s.range(10)).count() == 10
from regionmatch.operators import similarity as sim
g = s.createDataFrame([(0, y, x, [float(y), float(x * x)]) for y in range(6) for x in range(6)], "image int, gy int, gx int, vec array<double>")
row = sim.image_moments(g).first()
print("N", row.n, round(row.cov[0], 6), drop_written(s))
s.stop()
"""
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(ROOT), "SPARK_DRIVER_MEMORY": "1g"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert f"N 36 {round(np.var(np.repeat(np.arange(6), 6), ddof=1), 6)} 1" in out.stdout, out.stderr[-2000:]
