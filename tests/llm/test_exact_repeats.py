"""Substring operators, join and decontamination against brute force on small fixtures."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from regionmatch.llm import anchored, bwt_merge, fm_decontamination as fm, minhash_forest as mf, suffix_trees

WORD = re.compile("[^\x20\x09-\x0D]+")


def _phrase(seed, n):
    r = random.Random(seed)
    return [r.choice(["aa", "b", "ccc", "né", "中", "x" * r.randint(1, 9)]) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Overlapping passages, copies, a periodic text, nulls, empties, repeated rows, a null id, an id with two texts."""
    rng = random.Random(4)
    base = [_phrase(i, rng.randint(15, 80)) for i in range(12)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            b = base[rng.randrange(12)]
            a = rng.randrange(len(b))
            w += b[a:a + rng.randint(5, 60)]
            if rng.random() < 0.4:
                w += _phrase(1000 + i, rng.randint(1, 9))
        docs.append((i * 3 % 161, (" " if i % 3 else "\n").join(w) if i % 17 else None))
    docs += [(500, docs[3][1]), (501, " ".join(["z"] * 70)), (502, ""), (500, docs[3][1]), (None, docs[5][1]), (500, docs[7][1])]
    return docs


def _table(spark, rows):
    return spark.createDataFrame([(d, x, "other", 1) for d, x in rows], "doc_id long, text string, doc string, spans int")


def _key(d):
    return 10**18 if d is None else d


def brute_words(rows, width=20):
    import zlib

    seen, out = set(), {}
    for d, _, x in sorted({(_key(d), zlib.crc32((x or "").encode()), x or "") for d, x in rows}):
        w, gone = WORD.findall(x), set()
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            if k in seen:
                gone.update(range(i, i + width))
            seen.add(k)
        kept = " ".join(v for i, v in enumerate(w) if i not in gone)
        out[d, x] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted((_key(d), *out[_key(d), x or ""]) for d, x in rows)


def brute_bytes(rows, width=50):
    low, out = {}, []
    for d, x in rows:
        b = (x or "").encode()
        for i in range(len(b) - width + 1):
            low[b[i:i + width]] = min(low.get(b[i:i + width], _key(d)), _key(d))
    for d, x in rows:
        b = (x or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if low[b[i:i + width]] < _key(d):
                gone[i:i + width] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((_key(d), len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_word_repeats(spark, rows, hot):
    got = sorted((_key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in suffix_trees.dedup_words(_table(spark, rows), hot=hot).collect())
    assert got == brute_words(rows) and sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("hot", [20_000, 1])
def test_byte_repeats(spark, rows, hot):
    got = sorted((_key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_merge.dedup_bytes(_table(spark, rows), hot=hot).collect())
    assert got == brute_bytes(rows) and sum(r[2] for r in got) > 5000


@pytest.mark.parametrize("limit", [1, 3000])
def test_repeats_across_slices(spark, rows, monkeypatch, limit):
    """Slices of one row, which settle nothing by themselves, and of some rows give what whole partitions give."""
    monkeypatch.setattr(suffix_trees, "SLICE", limit)
    monkeypatch.setattr(bwt_merge, "SLICE", limit)
    got = suffix_trees.dedup_words(_table(spark, rows)).collect()
    assert sorted((_key(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows)
    got = bwt_merge.dedup_bytes(_table(spark, rows)).collect()
    assert sorted((_key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)


def test_cut_repeats_keeps_columns_and_untouched_texts(spark, rows):
    docs = spark.createDataFrame([(d, x, None if x is None else len(x), "s") for d, x in rows], "doc_id long, text string, n_chars long, source string")
    got = suffix_trees.cut_repeats(docs)
    assert got.columns == docs.columns
    assert got.count() == len(rows)
    removed = {(r.doc_id): r.n_removed for r in suffix_trees.dedup_words(docs).collect() if r.doc_id not in (None, 500)}
    texts = {d: x for d, x in rows}
    for r in got.collect():
        if r.doc_id in removed and removed[r.doc_id] == 0:
            assert r.text == texts[r.doc_id]
        elif r.text is not None and r.doc_id in removed:
            assert r.n_chars == len(r.text)


def test_prefix_parts_stay_small_and_whole():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 4000).astype(np.uint64)
    starts = np.arange(3900)
    parts = list(suffix_trees.prefix_parts(tokens, starts, 20, 50))
    assert all(len(own) <= 50 or length == 20 for own, length in parts)
    together = np.concatenate([own for own, _ in parts])
    assert len(np.unique(together)) == len(together)
    groups = defaultdict(list)
    for s in starts:
        groups[tokens[s:s + 20].tobytes()].append(s)
    where = {s: k for k, (own, _) in enumerate(parts) for s in own}
    assert all(len({where[s] for s in g}) == 1 for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("depth", [5, 6])
def test_merged_transforms_order_suffixes(depth):
    rng = np.random.default_rng(2)
    strings = [rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8) for _ in range(40)]
    cut = [strings[:9], strings[9:30], strings[30:]]
    shards = [bwt_merge.Transform(np.concatenate(c), np.array([len(s) for s in c])) for c in cut]
    row, border = bwt_merge.merge(shards, depth)
    suffixes = []
    for c, x in zip(cut, shards):
        first = np.concatenate([[0], np.cumsum([len(s) + 1 for s in c])])
        own = np.searchsorted(first, x.place, "right") - 1
        suffixes += [c[k][p - first[k]:].tobytes() for k, p in zip(own, x.place)]
    seen = [(suffixes[r] + b"\0")[:depth] for r in row]
    assert sorted(row) == list(range(len(suffixes))) and seen == sorted(seen)
    full = [k for k in range(1, len(seen)) if len(seen[k]) == depth and b"\0" not in seen[k]]
    assert all(border[k] == (seen[k] != seen[k - 1]) for k in full)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_trees.dedup_words(empty).count() == bwt_merge.dedup_bytes(empty).count() == mf.jaccard_join(empty).count() == 0
    assert fm.find_contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def brute_classes(rows):
    sets, by = [], defaultdict(list)
    for k, (d, x) in enumerate(rows):
        w = WORD.findall(x or "")
        s = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.append(s)
        for g in s:
            by[g].append(k)
    near = defaultdict(int)
    for own in by.values():
        for i in range(len(own)):
            for j in range(i):
                near[own[j], own[i]] += 1
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for (i, j), n in near.items():
        if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
            links[i] += 1
            links[j] += 1
            up[root(i)] = root(j)
    low = defaultdict(lambda: 10**18)
    for k, (d, _) in enumerate(rows):
        low[root(k)] = min(low[root(k)], _key(d))
    return sorted((_key(d), low[root(k)], links[k]) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize("leaf", [16, 2])
def test_join_equals_all_pairs(spark, leaf):
    rng = random.Random(8)
    rows = [(i, " ".join(_phrase(i, rng.randint(30, 90)))) for i in range(30)]
    for i in range(90):
        w = rows[rng.randrange(6 if i < 60 else 30)][1].split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        rows.append((100 + i, "  ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "two one"), (304, "one two"), (305, rows[0][1]), (None, rows[1][1]), (305, rows[0][1])]
    got = sorted((_key(r.doc_id), _key(r.class_id), r.n_links) for r in mf.jaccard_join(_table(spark, rows), leaf=leaf).collect())
    want = brute_classes(rows)
    assert got == want


def _near_texts():
    """Texts A, B with a near copy each, and a third text."""
    rng = random.Random(21)
    a, b, c = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abc")
    return a, " ".join(a.split()[:-1] + ["z"]), b, " ".join(b.split()[:-1] + ["y"]), c


@pytest.mark.parametrize("shared", [1, None])
@pytest.mark.parametrize("leaf", [16, 1])
def test_join_tells_texts_of_one_id_apart(spark, shared, leaf):
    a, near_a, b, near_b, c = _near_texts()
    rows = [(shared, a), (shared, near_b), (2, near_a), (3, b), (shared, c), (4, None), (shared, None)]
    got = sorted((_key(r.doc_id), _key(r.class_id), r.n_links) for r in mf.jaccard_join(_table(spark, rows), leaf=leaf).collect())
    assert got == brute_classes(rows)
    assert sum(n for _, _, n in got) == 4


def test_keep_one_row_of_each_class(spark):
    a, near_a, b, near_b, c = _near_texts()
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (None, c), (None, c), (None, near_a), (5, None), (5, ""), (6, None), (1, a), (None, None)]
    kept = mf.keep_one(_table(spark, rows))
    assert kept.columns == ["doc_id", "text", "doc", "spans"]
    assert sorted((_key(r.doc_id), r.text or "") for r in kept.collect()) == sorted([(1, a), (1, b), (_key(None), c), (5, ""), (5, ""), (6, ""), (_key(None), "")])
    assert mf.keep_one(_table(spark, [])).count() == 0


def test_segments_that_differ_in_high_bits_only_stay_apart():
    one = np.ones(2, np.int64)
    seg = np.array([5, 5 + (1 << 40)], np.uint64)
    packed = anchored._pack(0 * one, 1, np.array([1, 2]), one, np.arange(2), one, one, one.astype(np.uint64), seg)
    p = anchored.unpack(anchored.pa.Table.from_batches([packed]))
    assert p["seg"].tolist() == seg.tolist()
    assert not anchored.settle(p, True, 100)[0].any() and not anchored.settle(p, False, 100)[0].any()


@pytest.mark.parametrize("leaf, block", [(16, 1024), (16, 7), (2, 5)])
def test_join_counts_all_links_of_large_groups(spark, leaf, block):
    """Sixty different texts that are all near copies of one, a chain that drifts away, and copies of some."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(120)] = f"n{i}"
        if i % 2:
            w[rng.randrange(120)] = f"m{i}"
        texts.append(w)
    for i in range(40):
        w = list(texts[-1])
        w[3 * i:3 * i + 1] = [f"d{i}"]
        texts.append(w)
    rows = [(7 * i % 101, " ".join(w)) for i, w in enumerate(texts)] + [(200 + i, " ".join(texts[5 * i])) for i in range(12)]
    got = sorted((_key(r.doc_id), _key(r.class_id), r.n_links) for r in mf.jaccard_join(_table(spark, rows), leaf=leaf, signed_block=block, whole_block=block).collect())
    assert got == brute_classes(rows)


def test_least_depth_reaches_the_recall():
    k = mf.least_depth()
    assert 1 - (1 - 0.8**k) ** mf.TREES >= mf.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** mf.TREES


def brute_hits(docs, items):
    plain = lambda x: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    out = []
    for d, x in docs:
        w, hit, found = plain(x), set(), set()
        for item, y in items:
            v = plain(y)
            m = min(13, len(v))
            for j in range(len(v) - m + 1 if m else 0):
                for i in range(len(w) - m + 1):
                    if w[i:i + m] == v[j:j + m] and item is not None:
                        hit.update(range(i, i + m))
                        found.add(str(item))
        out.append((_key(d), len(w), len(hit), ",".join(sorted(found))))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 17, 60])
def test_decontamination(spark, block):
    rng = random.Random(5)
    words = ["The", "cat", "sat", "ÉTÉ", "x1", "don't", "中文", "b"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(9)] + [(3, text(20)), (20, "cat"), (21, ""), (22, None), (None, text(15))]
    docs = [(i, text(rng.randint(0, 20)) + " " + (items[rng.randrange(9)][1] if i % 2 else "") + "\n" + text(5)) for i in range(40)]
    docs += [(60, None), (61, ""), (62, items[0][1]), (62, items[0][1]), (None, "the CAT")]
    found = fm.find_contamination(_table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block=block)
    got = sorted((_key(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in found.collect())
    want = brute_hits(docs, items)
    assert got == want
    assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r.n_hit for r in found.collect())
    kept = fm.mark_contaminated(_table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), "bad", block=block)
    assert kept.columns == ["doc_id", "text", "doc", "spans", "bad"]
    assert sorted((_key(r.doc_id), r.bad) for r in kept.collect()) == sorted((d, n > 0 and 20 * n >= w) for d, w, n, _ in want)


def test_a_block_bounds_windows_of_long_items_and_of_shared_windows(spark):
    long = " ".join(f"w{i}" for i in range(900))
    items = [(0, long)] + [(i, "one two three four") for i in range(1, 200)]
    windows = fm.windows_of(spark.createDataFrame([(str(i), x) for i, x in items], "item_id string, text string"))
    assert windows.count() == 888 + 199
    docs = _table(spark, [(1, "x one two three four y"), (2, " ".join(long.split()[100:120])), (3, "nothing")])
    found = {r.doc_id: r for r in fm.find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block=300).collect()}
    assert (found[1].n_hit, len(found[1]["items"])) == (4, 199) and (found[2].n_hit, found[2]["items"]) == (20, ["0"]) and found[3].n_hit == 0
    assert [(s["first"], s["last"]) for s in found[1].spans] == [(1, 4)]
