"""Classifiers, quality rules, archives, preference pairs, pieces and the pipeline."""
import gzip
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from check_queries import compare, connect
from pyspark.sql import functions as F

from regionmatch.llm import compression_bands as cb, labels as lab, piece_lattice as pl, preference_format as pf, queries
from regionmatch.llm import random_indexing as ri, text as t, toxicity_grammar as tg, warc_chunks as wc

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, con, name):
    result, _, _ = compare(spark, con, queries.QUERIES[name], queries.ORACLE[name], SF)
    assert result.startswith("ok") and "TYPES" not in result, result


def _odd_documents(spark):
    rows = [(1, None, "x", 0.5), (2, "", "x", 0.5), (None, "some text here", "x", 0.5), (3, "word " * 30_000, "x", 0.5), (3, "word " * 30_000, "x", 0.5), (4, "\n\n \t", "x", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, score double")


# ---- quality and toxicity ---------------------------------------------------------------


def test_held_out_is_crc_of_the_digits(spark):
    import zlib

    got = spark.range(50).select("id", lab.held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)]


def test_quality_beats_the_majority_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_random_indexing_quality(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    share = np.mean([r.quality for r in rows])
    assert right > max(share, 1 - share) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_toxicity_grammar(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert np.mean([r.predicted for r in toxic]) > 0.6
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.03


def test_models_on_odd_rows_and_without_labels(spark):
    docs, none = _odd_documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    grammar = tg.fit(docs, none)
    scored = tg.score(docs, grammar).collect()
    assert len(scored) == 6 and len({r.score for r in scored}) == 1
    assert tg.score_column(docs, grammar).columns == ["doc_id", "text", "row", "score"]
    pooler, network = ri.fit(docs, none)
    assert {r.score for r in ri.score(docs, pooler, network).collect()} == {0.5}
    empty = docs.filter("false")
    assert ri.score(empty, *ri.fit(empty, none)).count() == tg.score(empty, grammar).count() == 0


def test_labels_held_out_are_never_learned_from(spark):
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    held = {r[0] for r in labels.filter(lab.held_out(F.col("doc_id"))).collect()}
    assert held and not held & {i for i, _ in lab.training_sample(labels, "toxic", per_class=200)}
    assert len(lab.training_sample(labels, "toxic", rows=7)) == 7


def _clauses(text, insults):
    g = tg.Grammar(insults, np.array([-3.0, 0.6, 0.0, 0.6]))
    data = np.frombuffer(text.encode(), np.uint8)
    row, first, last, score, _ = g.clauses(data, np.array([0, len(data)]))
    return [(text.encode()[a:b].decode(), round(float(s), 6)) for a, b, s in zip(first, last, score)]


def test_grammar_weighs_clauses():
    insults = {b"fool": 4.0, b"^schur": 3.0}
    assert _clauses("You fool. A fool!", insults) == [("You fool", 4.0), ("fool", 3.2)]
    assert _clauses("you are not a fool, you fool", insults) == [("you are not a fool", 1.2), ("you fool", 4.0)]
    assert _clauses("she said you fool", insults)[0][1] == 2.0
    assert _clauses("they will hurt", insults)[0][1] == 2.0 and _clauses("hurt", insults)[0][1] == pytest.approx(0.32)
    assert _clauses("Ein SCHURKE", insults) == [("SCHURKE", 2.4)]
    assert _clauses("nothing of the kind", insults) == []


def test_composed_automaton_equals_running_the_parts():
    machines = (tg.NEGATING, tg.REPORTING, tg.TARGETING, tg.THREATENING)
    for symbols in itertools.product(range(1, 6), repeat=4):
        states, total = [0] * 4, 0.0
        for s in symbols:
            f = 1.0
            for k, m in enumerate(machines):
                states[k], own = m.get((states[k], s), (states[k], 1.0))
                f *= own
            total += f * s
        _, got = tg.clause_scores(np.array(symbols), np.array(symbols, float), np.zeros(4, np.int64))
        assert got[0] == pytest.approx(total * tg.FINAL_TARGET[states[2]])


def test_temperature_and_network_separate_classes():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    n = ri.Network().fit(x, y)
    assert np.mean((n.probability(x) >= 0.5) == y) > 0.9 and n.temperature > 0


# ---- quality rules ----------------------------------------------------------------------


def test_counts_and_verdicts_equal_a_plain_reading(spark):
    rng = random.Random(1)
    texts = [None, "", "a b c d e a b c d e x y", "one\ntwo\none\n\none \n", "#a* $5 & é中 <b>|%", "x " * 500, "long " + "é" * 3000]
    texts += [" ".join(rng.choice(["der", "die", "née", "#", "a|b"]) + rng.choice(["", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) + rng.choice(["", " "]) for _ in range(4000)), " ".join(f"{rng.getrandbits(40):x}" for _ in range(2000))]
    docs = spark.createDataFrame([(i, x, 9) for i, x in enumerate(texts)], "doc_id long, text string, n_words int")
    packer = zstandard.ZstdCompressor(level=cb.LEVEL)
    for r in cb.compression_bands(docs).collect():
        x = texts[r.doc_id] or ""
        w = WORD.findall(x)
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        many = Counter(windows)
        hit = {k for i, v in enumerate(windows) if many[v] > 1 for k in range(i, i + 5)}
        lines = [line for line in x.split("\n") if WORD.search(line)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        raw = x.encode()
        parts = [raw[i:i + cb.CHUNK] for i in range(0, len(raw), cb.CHUNK)]
        fits = bool(raw) and cb.in_band(len(raw), len(packer.compress(raw)))
        if len(parts) > 1:
            fits = fits and sum(not cb.in_band(len(p), len(packer.compress(p))) for p in parts) <= cb.BAD_CHUNKS * len(parts)
        assert (r.base_failed, r.kept) == (failed, fits and not failed)


def test_bands_keep_prose_and_reject_noise_and_repeats(spark):
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1"), "doc_id")
    rows = cb.compression_bands(prose).filter("not base_failed").collect()
    assert np.mean([r.kept for r in rows]) > 0.99
    rng = random.Random(2)
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(8)) for _ in range(900))
    listed = " ".join(f"item number {i} costs exactly {i * 7} euros and ships within {i % 5} days" for i in range(4000))
    bad = spark.createDataFrame([(1, noise), (2, listed)], "doc_id long, text string")
    assert not any(r.kept for r in cb.compression_bands(bad).collect())


# ---- archives ---------------------------------------------------------------------------


def test_archive_round_trip_with_segments(spark, tmp_path):
    big, rng = "é\r\n\r\nWARC/1.1\r\n" * 700, random.Random(3)
    pages = [(1, "http://a/", "x" * 1000), (7, "http://b/ c", "x" * 1000), (3, None, "x" * 1000), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (8, "u", ""),
             (9, "u", big), (11, "u", "\r\n\r\n"), (12, "u", "ends\r"), (None, "u", "x" * 1000), (1, "again", "x" * 1000), (13, "u", "".join(chr(rng.randint(1, 0x2FFF)) for _ in range(5000)))]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "archive")
    wc.write_archive(df, path, chunk=500)
    chunks = wc.read_chunks(spark, path, chunk=500)
    rows = chunks.collect()
    assert max(len(r.data) for r in rows) <= 500
    held = {}
    for r in rows:
        held.setdefault((r.page_id, r.record_type, r.declared), []).append((r.chunk_no, bytes(r.data), r.digest_so_far, r.bytes_so_far))
    whole = b"".join(d for _, d, _, _ in sorted(held[9, "response", hashlib.sha1(big.encode()).hexdigest()]))
    assert whole == big.encode()
    so_far = hashlib.sha1()
    for _, data, digest, _ in sorted(held[9, "response", hashlib.sha1(big.encode()).hexdigest()]):
        so_far.update(data)
        assert digest == so_far.hexdigest()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in wc.records(chunks).collect())
    want = Counter()
    for page, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == raw and p is not None]
        keep = max(same)
        revisit = len(raw) >= 1000 and page != keep
        want[page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keep if revisit else None] += 1
    assert got == want
    raw = b"".join(gzip.open(p, "rb").read() for p in sorted((tmp_path / "archive").glob("part-*.gz")))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.count(b"WARC-Type: continuation") > 20 and raw.endswith(b"\r\n\r\n")


def test_archive_of_nothing(spark):
    assert wc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- preference pairs -------------------------------------------------------------------


def test_preference_pairs(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "fine"),
            (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "alone"),
            (5, 0, None, None), (5, 1, "assistant", "x"), (None, 0, "user", "n"), (6, 0, "user", "q"), (6, 1, "assistant", "a")]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, chosen string")
    got = {r.pair_id: r for r in pf.preference_format(pf.pairs_of(table)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    two, three, one = got[2], got[3], got[1]
    assert (two.chosen_id, two.n_common, two.prompt) == (1, 1, "<|user|>\nhi<|end|>\n")
    assert two.rejected_text == "<|assistant|>\nno<|end|>\n" and two.chosen_text.startswith("<|assistant|>\nyes")
    spans = [tuple(map(int, s.split("-"))) for s in two.chosen_mask.split(",")]
    assert [two.chosen_text[a:b] for a, b in spans] == ["yes<|end|>\n", "fine<|end|>\n"]
    assert three.n_common == 2 and three.rejected_text == "" and three.rejected_mask == ""
    assert one.n_common == 3 and one.rejected_text == "<|assistant|>\nyes<|end|>\n"
    assert got[6].rejected_text == "<|assistant|>\nq<|end|>\n" and got[4].rejected_text == "" and got[5].n_common == 1
    plan = pf.preference_format(pf.pairs_of(table))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- pieces -----------------------------------------------------------------------------


def _all_paths(part, v, n):
    into, paths = pl.edges(part, v), {0: [0.0]}
    for e in range(1, len(part) + 1):
        paths[e] = [a + x for s, _, x in into[e] for a in paths.get(s, [])]
    return sorted((round(-a, 6) for a in paths[len(part)]))[:n]


def test_n_best_equals_enumeration_and_decodes(spark):
    v = pl.load()
    texts = ["", "a", "the cat", "hello world ", "Éaiç 中▁x\n\n yy", "  two  spaces", "aaaaaaa", "\n", "x" * 90, "\U0001F600 ok", " " * 40 + "z", None]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    coded = pl.decode(pl.encode(docs, v, keep=("text",)), v)
    for r in coded.collect():
        x = r.text or ""
        assert r.decoded == x
        scores = [s.score for s in r.segmentations]
        assert scores == sorted(scores, reverse=True)
        if 0 < len(x) < 14:
            assert [round(-s, 6) for s in scores] == _all_paths(b" " + x.encode(), v, 4)
        seen = set()
        for s in r.segmentations:
            ids = list(r["ids"])
            for e in sorted(s.edits, key=lambda e: -e["at"]):
                ids[e["at"]:e["at"] + e["drop"]] = e["put"]
            seen.add(tuple(ids))
            flat, _ = pl.decode_ids(np.array(ids, np.int64), np.array([0, len(ids)]), v)
            assert flat.tobytes() == x.encode() and abs(sum(v.scores[i] for i in ids) - s.score) < 1e-6
        assert len(seen) == len(r.segmentations)


def test_backward_search_orders_all_paths():
    v = pl.load()
    into = pl.edges(b" another one", v)
    found = pl.n_best(into, 200)
    assert [round(-s, 6) for s, _ in found] == _all_paths(b" another one", v, 200)


def test_lockstep_equals_single_parts():
    v = pl.load()
    parts = [b" the", b"ing", "né".encode(), b"zqxj", " 中文".encode(), b"=" * 63, b" international", b"\n"]
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    best, second, n, at, flat = pl.viterbi(data, np.cumsum(size) - size, size, v)
    for k, p in enumerate(parts):
        one, two, ids = pl._second(pl.edges(p, v))
        assert best[k] == pytest.approx(one) and (second[k] < -1e17 if two < -1e17 else second[k] == pytest.approx(two))
        assert v.scores[flat[at[k]:at[k] + n[k]]].sum() == pytest.approx(one)


# ---- pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, names = [docs.count()], docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if k < len(cp.STAGES) - 1:
            assert docs.columns == names
    assert len(cp.STAGES) == 5 and counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.filter("not exact").count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (None, "a b c", "en", "s", 5), (3, "w x y z v u " * 30, "en", "s", 1), (4, "w x y z v u " * 30, "en", "s", 1), (4, "w x y z v u " * 30, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for own in (docs, docs.filter("false")):
        for _, stage in cp.STAGES:
            assert stage(spark, own, SF).count() <= own.count()
    assert sorted(str(r.doc_id) for r in cp.jaccard_join(spark, docs, SF).collect()) == ["1", "2", "3", "None"]


def test_pipeline_keeps_columns_of_clashing_names_and_texts_that_share_an_id(spark):
    import corpus_pipeline as cp

    rng = random.Random(6)
    text = lambda k: " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(40))
    rows = [(1, text("a"), 7.5e-9, 777, ["mine"], [1], "k"), (1, text("b"), 0.25, 3, [], [2], "l"), (None, text("c"), 0.5, 1, None, None, None), (None, text("d"), 1.0, 2, ["x"], [3], "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, n_words int, items array<string>, spans array<int>, contaminated string")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "score", "n_words", "items", "spans", "contaminated"]
    assert sorted(map(str, docs.collect())) == sorted(map(str, spark.createDataFrame(rows, docs.schema).collect()))
    assert cp.STAGES[-1][1](spark, docs, SF).count() == 4
