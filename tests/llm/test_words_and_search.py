"""Spelling variants, license scan and ranked search against brute force on small fixtures."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionmatch.llm import license_scans as ls, ranked_search as rs, spelling_variants as sv

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _docs(spark, rows):
    """Documents with columns named like those the operators work with."""
    return spark.createDataFrame([(d, x, "w", 1, 2, "t") for d, x in rows], "doc_id long, text string, word string, n long, list long, label string")


def brute_variants(rows):
    count = Counter()
    for d, x in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    form, many = {}, {}
    for w, n in words.items():
        near = [o for o in words if o != w and _near(w, o)]
        best = min(near, key=lambda o: (-words[o], o), default=None)
        form[w], many[w] = best if best and words[best] >= 2 * n else None, len(near)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, many[w], words[form[w]] if form[w] else 0) for w, n in words.items())


@pytest.mark.parametrize("most", [2048, 3])
def test_variants_equal_all_pairs(spark, most):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcéÿ") for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["z" * 300]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = base[min(int(rng.expovariate(0.08)), 40)]
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1:]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i % 140, rng.choice([" ", ", ", "5", "\n"]).join(words)))
    rows += [(500, None), (501, ""), (None, base[0] + " " + base[1]), (502, "Hello hello HELLO hellO jello jello jello ÉÉÉÉÉ ÉÉÉÉÉ ÉÉÉÉÉ"), (502, "Hello hello HELLO hellO")]
    got = [(r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in sv.spelling_variants(_docs(spark, rows), most=most).collect()]
    want = brute_variants(rows)
    assert sorted(got) == want and any(w[1] for w in want) and any(w[4] > 3 for w in want)


def test_variants_of_nothing(spark):
    assert sv.spelling_variants(_docs(spark, [])).count() == 0
    assert sv.spelling_variants(_docs(spark, [(1, None), (2, "a b c")])).count() == 0


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "b")]
    got = {r.word: r.root for r in sv.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{i}": "w37" for i in range(37)} | {"a": "b"}


@pytest.mark.parametrize("seed", range(20))
def test_sorted_lists_find_all_pairs_one_edit_apart(seed):
    rng = random.Random(seed)
    m = rng.randint(1, 7)
    one = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([m, m + 1]))) for _ in range(60)})
    two = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([3, 4]))) for _ in range(20)})
    words, lists = one + two, np.array([1] * len(one) + [2] * len(two))
    short = np.array([m] * len(one) + [3] * len(two))
    q, other = sv.near_in_lists(words, lists, short)
    want = sorted((i, j) for i in range(len(words)) for j in range(len(words)) if i != j and lists[i] == lists[j] and len(words[i]) == short[i] and _near(words[i], words[j]))
    assert sorted(zip(q.tolist(), other.tolist())) == want


def test_words_may_be_one_apart_but_only_at_their_ends(spark):
    words = spark.createDataFrame([("abcde", 9), ("bcdef", 9), ("abcdef", 9), ("xabcde", 20), ("aabcde", 3)], "word string, n long")
    got = {r.word: (r.n_near, r.form) for r in sv.grouped(words).collect()}
    assert got == {"abcde": (3, "xabcde"), "bcdef": (1, None), "abcdef": (2, None), "xabcde": (2, None), "aabcde": (2, "xabcde")}


def brute_licenses(rows, templates, threshold):
    plain = lambda x: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOWER))
    span = max(len(plain(x)) for _, x in templates)
    out = []
    for d, x in rows:
        w = plain(x or "")
        places = [(i, label) for phrase, label in ls.PHRASES for own in [phrase.split()] for i in range(len(w)) if w[i:i + len(own)] == own]
        best, labels = 0.0, {label for _, label in places}
        for line in (x or "").split("\n"):
            v = plain(line)
            for s in range(0, max(len(v) - span - 1, 0) + 1, span):
                for label, y in templates:
                    own = set(plain(y))
                    part = len(own & set(v[s:s + 2 * span])) / len(own)
                    if part >= threshold - 1e-12:
                        best, labels = max(best, part), labels | {label}
        at = [i for i, _ in places]
        out.append((-1 if d is None else d, len(w), len(at), min(at, default=-1), max(at, default=-1), ",".join(sorted({k for _, k in places})), ",".join(sorted(labels)), 1.0 if at else best))
    return sorted(out)


@pytest.mark.parametrize("threshold, templates", [(0.9, ls.TEMPLATES), (0.5, ls.TEMPLATES), (0.7, (("a", "x y z"), ("b", "p q r s t u v"), ("a", "y y y")))])
def test_licenses_equal_all_blocks_with_all_templates(spark, threshold, templates):
    rng = random.Random(9)
    pool = [w for _, x in templates for w in ls.tokens(x)] + ["MIT", "License", "Apache", "foo", "été", "public", "general"]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 90))) for _ in range(rng.randint(0, 3))]
        for _ in range(rng.randint(0, 2)):
            words = list(rng.choice(templates)[1].split())
            rng.shuffle(words)
            lines.insert(0, ", ".join(words[:rng.randint(1, len(words))]))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "MIT\nLicense. mit-license MIT license"), (202, "MIT license"), (202, "MIT license"), (None, rows[0][1]),
             (203, "foo " * 5000 + templates[0][1] + " bar" * 5000), (204, "General Public License")]
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels, r["labels"], r.score)
           for r in ls.license_scan(_docs(spark, rows), templates=templates, threshold=threshold).collect()]
    assert sorted(got) == brute_licenses(rows, templates, threshold)


def test_license_plan_has_no_python(spark):
    plan = ls.license_scan(_docs(spark, [(1, "Released under the MIT License.")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert ls.license_scan(_docs(spark, [])).count() == 0


def brute_search(docs, items, k=10):
    terms = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (x or "").translate(LOWER))
    bags = [(10**18 if d is None else d, Counter(terms(x))) for d, x in docs]
    some, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    need = {}
    for i, x in sorted(set(items), key=str):
        need.setdefault(i, Counter()).update(terms(x))
    for i, own in need.items():
        found = []
        for d, b in bags:
            m = 25 + (75 * b.total() * some) // total if total else 0
            s = sum(n * math.floor(1000 * math.log((2 * some + 2) / (2 * df[w] + 1))) * ((1000000000 * b[w]) // (1000 * b[w] + 8 * m)) for w, n in own.items() if w in b)
            if s > 0:
                found.append((-s, d))
        out += [(str(i), r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_search_equals_scoring_every_document(spark, block):
    rng = random.Random(2)
    pool = ["The", "cat", "CATS", "a", "É", "中文", "x1", "été", "don't", "naïve", "b", "bb", "bbb"]
    text = lambda n: rng.choice([" ", "--", "\n"]).join(rng.choice(pool) for _ in range(n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(200)] + [(300, None), (301, ""), (302, "cat"), (302, "cat"), (None, "x1 cat"), (303, "cat"), (304, "cats cat " * 3000)]
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(20, None), (21, "nowhere"), (22, "cat cat"), (22, "cat cat"), (22, "b"), (None, "x1")]
    table = spark.createDataFrame([(i, x, "doc", 1) for i, x in items], "item_id long, text string, doc string, score int")
    got = sorted((str(r.item_id), r["rank"], 10**18 if r.doc_id is None else r.doc_id, r.score) for r in rs.ranked_search(_docs(spark, docs), table, block=block).collect())
    assert got == brute_search(docs, items)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "item_id string, text string")
    assert rs.ranked_search(_docs(spark, [(1, "a")]), none).count() == 0
    assert rs.ranked_search(_docs(spark, []), spark.createDataFrame([("i", "a b")], none.schema)).count() == 0


def test_blocks_hold_their_bound_or_one_item(spark):
    items = spark.createDataFrame([(i, " ".join(f"t{i}x{j}" for j in range(i))) for i in range(60)], "item_id long, text string")
    blocked = rs._blocked(rs.terms_of(items), 500)
    for r in blocked.groupBy("bucket", "part").agg(F.sum(F.octet_length("term") + 1).alias("size"), F.count_distinct("item_id").alias("items"), F.max("item_id").alias("most")).collect():
        assert r["items"] == 1 or r["size"] < 500 + 8 * 60
    assert blocked.count() == sum(range(60))
