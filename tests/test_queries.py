"""Registered queries against their SQL twins on the smallest tables."""
import pytest
from check_queries import compare, connect

from regionmatch.plans import contract_checks, matching, raster, regions, registry, scoring, training

SF = "/root/testdata/sf0.001"
# Whole families that are quick, and some of each slower family; check_queries.py runs all.
NAMES = [*scoring.QUERIES, *contract_checks.QUERIES, *training.QUERIES, "box_mean", "median3", "gradient", "paper_tone", "components4",
         "fill_holes", "hysteresis", "component_ranks", "cosine_map", "exemplar_cosines", "bilinear", "compete", "spectra", "blob_table",
         "correlation", "component_oracle", "cut_rule", "masks_from_probabilities", "region_similarity"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    result, _, _ = compare(spark, con, registry.QUERIES[name], registry.ORACLE[name], SF)
    assert result.startswith("ok") and "TYPES" not in result, result


def test_every_sql_twin_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
