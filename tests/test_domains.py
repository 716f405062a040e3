import pytest

from regionmatch.operators import domains, metrics
from regionmatch.operators.contracts import ContractError
from regionmatch.plans.end_to_end import score_files

BASE = dict(id="q", image="a.png", width=4, height=4, document_id="d", kind="toy", query_box=[0, 0, 1, 1], context_boxes=[[1, 0, 2, 1]],
            labels=dict(positive_boxes=[[0, 0, 4, 1]], negative_boxes=[[0, 1, 4, 2]], blank_boxes=[[0, 1, 2, 2]]))


def run(spark, tmp_path, example, boxes, masks=()):
    import json

    path = tmp_path / "m.json"
    path.write_text(json.dumps({"schema": "s", "examples": [example]}))
    schema = "query string, kind string, y int, x0 int, x1 int"
    pred = spark.createDataFrame([("q", y, x0, x1) for x0, y0, x1, y1 in boxes for y in range(y0, y1)] or [("q", -1, 0, 0)], "query string, y int, x0 int, x1 int")
    rows, _ = score_files(spark, str(path), spark.createDataFrame(list(masks), schema), pred)
    return rows.first()


def test_all_selected(spark, tmp_path):
    r = run(spark, tmp_path, BASE, [(0, 0, 4, 4)])
    assert (r["tp"], r["fp"], r["fn"]) == (2, 4, 0)
    assert r["iou"] == pytest.approx(1 / 3) and r["blank_false_positive_rate"] == 1
    assert (r["unscored_pixels"], r["excluded_known_pixels"]) == (10, 2)


def test_unknown_and_support_do_not_count(spark, tmp_path):
    r = run(spark, tmp_path, BASE, [(2, 0, 4, 1), (0, 1, 4, 2)])
    assert (r["tp"], r["fp"], r["fn"]) == (2, 4, 0)


def test_positive_only(spark, tmp_path):
    r = run(spark, tmp_path, dict(BASE, labels=dict(positive_boxes=[[2, 2, 4, 4]])), [(0, 0, 4, 4)])
    assert r["positive_only"] and r["reviewed_pixels"] == 4 and r["fp"] == 0 and r["iou"] == 1


def test_explicit_known_with_a_blank_mask(spark, tmp_path):
    ex = dict(BASE, labels=dict(known_boxes=[[0, 0, 4, 4]], blank_mask="b.png"))
    r = run(spark, tmp_path, ex, [(0, 0, 4, 4)], [("q", "blank", 2, 2, 4), ("q", "blank", 3, 2, 4)])
    assert r["iou"] is None and r["fp"] == 14 and r["blank_fp"] == 4 and r["empty_target_false_positive_rate"] == 1


@pytest.mark.parametrize("labels", [
    dict(positive_boxes=[[0, 0, 4, 1]], negative_boxes=[[3, 0, 4, 1]]),  # overlap
    dict(positive_boxes=[[0, 2, 4, 3]], known_boxes=[[0, 0, 4, 2]]),  # outside the known region
    dict(positive_boxes=[[0, 0, 1, 1]]),  # nothing left to score
    dict(positive_boxes=[[0, 0, 5, 1]]),  # outside the drawing
    dict(other_boxes=[[0, 0, 1, 1]]),  # unknown field
])
def test_contradictions_are_rejected(spark, tmp_path, labels):
    with pytest.raises(ContractError):
        run(spark, tmp_path, dict(BASE, labels=labels), [(0, 0, 4, 4)])


def test_missing_prediction_is_rejected(spark, tmp_path):
    with pytest.raises(ContractError):
        import json

        path = tmp_path / "m.json"
        path.write_text(json.dumps([BASE]))
        score_files(spark, str(path), spark.createDataFrame([], "query string, kind string, y int, x0 int, x1 int"),
                    spark.createDataFrame([], "query string, y int, x0 int, x1 int"))


def test_sweep_against_pixels(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    boxes, want = [], {k: np.zeros((20, 30), bool) for k in domains.KINDS}
    for k in domains.KINDS:
        for _ in range(4):
            x0, y0 = rng.integers(0, 25), rng.integers(0, 15)
            x1, y1 = x0 + rng.integers(1, 6), y0 + rng.integers(1, 5)
            want[k][y0:y1, x0:x1] = True
            boxes.append(("q", k, int(x0), int(y0), int(x1), int(y1)))
    df = spark.createDataFrame(boxes, "query string, kind string, x0 int, y0 int, x1 int, y1 int")
    got = {k: np.zeros((20, 30), bool) for k in domains.KINDS}
    for r in domains.flag_runs(domains.slabs(df)).collect():
        for k in domains.KINDS:
            got[k][r["y"]:r["y"] + r["rows"], r["x0"]:r["x1"]] |= r[k]
    for k in domains.KINDS:
        assert (got[k] == want[k]).all()
