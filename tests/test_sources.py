import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from regionmatch.operators import contracts
from regionmatch.sources import grids, integrity, manifest, rasters, sinks

EX = dict(id="q1", image="a.png", width=4, height=4, document_id="d", kind="toy", query_box=[0, 0, 1, 1], labels=dict(positive_boxes=[[0, 0, 4, 1]]))


def write(path, obj):
    path.write_text(json.dumps(obj))
    return str(path)


def png(path, rows, depth=8):
    w, h = len(rows[0]), len(rows)
    if depth == 8:
        raw = b"".join(b"\0" + bytes(r) for r in rows)
    else:
        raw = b"".join(b"\0" + int("".join(str(v) for v in r).ljust(-(-w // 8) * 8, "0"), 2).to_bytes(-(-w // 8), "big") for r in rows)
    part = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_object_and_bare_list_read_alike(spark, tmp_path):
    a = manifest.load_manifest(spark, write(tmp_path / "a.json", {"schema": "s", "examples": [EX]}))
    b = manifest.load_manifest(spark, write(tmp_path / "b.json", [EX]))
    assert a.drop("record").collect() == b.drop("record").collect()
    assert a.first()["query_box"] == [0, 0, 1, 1]


@pytest.mark.parametrize("change,rule", [
    (dict(query_box=[0, 0, 5, 1]), "bad_query_box"), (dict(query_box=[0, 0, 1.0, 1]), "bad_query_box"), (dict(query_box=[0, 0, True, 1]), "bad_query_box"),
    (dict(width=True), "bad_size"), (dict(id="../x"), "bad_id"), (dict(kind=""), "missing_kind"), (dict(labels={}), "labels_missing"),
    (dict(labels=dict(positive_mask="")), "bad_mask_path"), (dict(labels=dict(odd_mask="x")), "unknown_label_field"),
    (dict(context_boxes=[[0, 0, 0, 1]]), "bad_context_box"),
])
def test_broken_manifests(spark, tmp_path, change, rule):
    m = manifest.read_manifest(spark, write(tmp_path / "m.json", [dict(EX, **change)]))
    assert rule in {r["rule"] for r in contracts.manifest_violations(m).collect()}


def test_duplicate_ids_and_label_free_mode(spark, tmp_path):
    with pytest.raises(contracts.ContractError):
        manifest.load_manifest(spark, write(tmp_path / "d.json", [EX, EX]))
    free = {k: v for k, v in EX.items() if k not in ("labels", "document_id", "kind")}
    path = write(tmp_path / "f.json", [free])
    with pytest.raises(contracts.ContractError):
        manifest.load_manifest(spark, path)
    assert manifest.load_requests(spark, path).count() == 1
    with pytest.raises(contracts.ContractError):
        manifest.load_requests(spark, write(tmp_path / "g.json", [EX]))


def test_export_keeps_public_fields_only(spark, tmp_path):
    m = manifest.load_manifest(spark, write(tmp_path / "m.json", [EX]))
    out = str(tmp_path / "out")
    sinks.write_requests(m, out)
    row = json.loads(spark.read.text(out).first()[0])
    assert row == {k: EX[k] for k in ("id", "image", "width", "height", "query_box")}


@pytest.mark.parametrize("path,bad", [("a/b.png", False), ("a/../b.png", False), ("a/../../b.png", True), ("/a.png", True), ("", True), ("..", True)])
def test_paths_stay_under_the_root(spark, path, bad):
    assert spark.createDataFrame([(path,)], "p string").select(contracts.escapes_root(F.col("p"))).first()[0] is bad


@pytest.mark.parametrize("command,bad", [
    ("python r.py --inputs a --data-root b --output-dir c", False), ("python r.py --inputs=a --data-root=b --output-dir=c", False),
    ("--inputs a --data-root b --output-dir c", True), ("python r.py --inputs a --data-root b", True),
    ("python r.py --inputs a --inputs b --data-root c --output-dir d", True), ("python r.py --inputs --data-root c --output-dir d", True),
    ("python r.py --inputs= --data-root c --output-dir d", True), ("python r.py --inputs a --data-root b --output-dir", True)])
def test_command_flags(spark, command, bad):
    assert spark.createDataFrame([(command,)], "c string").select(contracts.bad_command(F.col("c"))).first()[0] is bad


def test_masks_in_both_encodings(spark, tmp_path):
    png(tmp_path / "a.png", [[0, 255, 255, 0], [255, 0, 0, 255]])
    png(tmp_path / "b.png", [[0, 1, 1], [1, 0, 0]], 1)
    png(tmp_path / "c.png", [[0, 1, 255]])
    png(tmp_path / "d.png", [[0, 127, 0]])
    runs, bad = rasters.binary_masks(spark, str(tmp_path))
    name = lambda r: r["path"].split("/")[-1]
    got = sorted((name(r), r["y"], r["x0"], r["x1"]) for r in runs.collect() if name(r) in ("a.png", "b.png"))
    assert got == [("a.png", 0, 1, 3), ("a.png", 1, 0, 1), ("a.png", 1, 3, 4), ("b.png", 0, 1, 3), ("b.png", 1, 0, 1)]
    assert sorted(map(name, bad.collect())) == ["c.png", "d.png"]
    h = rasters.headers(spark, str(tmp_path))
    paths = {r["path"].split("/")[-1]: r["path"] for r in h.collect()}
    want = spark.createDataFrame([(paths["a.png"], 4, 2), (paths["b.png"], 4, 2), ("file:/none.png", 1, 1)], "path string, width int, height int")
    assert sorted(r["rule"] for r in rasters.header_problems(h, want).collect()) == ["missing", "wrong_shape"]


def test_integrity(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"abcd")
    sha = hashlib.sha256(b"abc").hexdigest()
    want = spark.createDataFrame([("a.bin", 3, sha), ("b.bin", 3, sha), ("c.bin", 1, sha)], "name string, bytes long, sha256 string")
    got = {r["name"]: r["rule"] for r in integrity.file_problems(spark, str(tmp_path), want).collect()}
    assert got == {"b.bin": "size", "c.bin": "missing"}


def test_sinks_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("q1", 0, 1, 3), ("q2", 1, 0, 2)], "query string, y int, x0 int, x1 int")
    sinks.write_masks(runs, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.count() == 2 and sinks.not_yet_written(spark.createDataFrame([("q1",), ("q3",)], "query string"), back, "query").first()[0] == "q3"
    rep = spark.createDataFrame([(1.0, None)], "b double, a double")
    sinks.write_report(rep, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a":null,"b":1.0}'
    with pytest.raises(ValueError):
        sinks.write_report(spark.createDataFrame([(float("nan"),)], "b double"), str(tmp_path / "x"))
    sinks.append_result(rep, str(tmp_path / "log"))
    sinks.append_result(rep, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_probabilities(spark.createDataFrame([("q", 0, 0, 0.0)], "query string, gy int, gx int, p double"), str(tmp_path / "p"))
    assert grids.probability_grids(spark, str(tmp_path / "p"), logits=True).first()["p"] == 0.5


def test_domain_table_builds_missing_queries_once(spark, tmp_path):
    calls = []

    def build(done):
        calls.append(done)
        every = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "query string, y int, x int")
        return every.filter("query = 'a'") if done is None else every.join(done, "query", "left_anti")

    path = str(tmp_path / "d")
    assert grids.domain_table(spark, path, build).count() == 1
    assert grids.domain_table(spark, path, build).count() == 2
    assert grids.domain_table(spark, path, build).count() == 2
