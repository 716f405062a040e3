"""The classifiers' inputs and scores against plain readings of whole texts, one word at a time."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from regionmatch.llm import random_indexing as ri, text as t, toxicity_grammar as tg

TEXTS = ["Good day, good people! We 2 met (at 10:30) in ÉTÉ 中文.", "", None, "a", "one two three two one", " \n\t", "x" * 400 + " don't  stop", "Ça va? ça VA! " * 30]


def _slot(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(ri.slots(t.hashes(data, np.array([0]), np.array([len(data)])))[0])


def _index(slot):
    where, sign = ri.index_vectors()
    out = np.zeros(ri.DIMS)
    for p, s in zip(where[slot], sign[slot]):
        out[p] += s
    return out


def _words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def _shape(word):
    def kind(b):
        c = chr(b)
        return 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" or b >= 0x80 else 3 if "0" <= c <= "9" else 4 if c in ".,;:'\"-()?" else 5 if c == "!" else 0

    b = word.encode()
    key = 0
    for at in (0, min(1, len(b) - 1), max(len(b) - 2, 0), len(b) - 1):
        key = key * 8 + kind(b[at])
    key = key * 16 + min(int(np.log2(len(b) + 1)), 15) + (1 << 40)
    return int(ri.slots(t.mix(np.array([key], np.uint64)))[0])


def _docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_context_vectors_are_sums_over_neighbours(spark):
    want = defaultdict(lambda: np.zeros(ri.DIMS))
    for text in TEXTS:
        w = _words(text)
        for i, word in enumerate(w):
            for j in range(max(0, i - ri.WINDOW), min(len(w), i + ri.WINDOW + 1)):
                if i != j:
                    want[_slot(word)] += _index(_slot(w[j]))
    got = ri.context_table(_docs(spark))
    live = {s for s, v in want.items() if np.abs(v).sum()}
    assert set(np.flatnonzero(np.abs(got).sum(1))) == live
    for s in live:
        assert np.abs(got[s] - want[s] / np.linalg.norm(want[s])).max() < 1e-6


def test_pooling_is_mean_and_spread_of_word_vectors(spark):
    context = ri.context_table(_docs(spark))
    pooler = ri.Pooler(context)
    texts = [x or "" for x in TEXTS]
    raw = [x.encode() for x in texts]
    got = pooler.features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    for text, x in zip(texts, got):
        words = _words(text)
        if not words:
            assert not x.any()
            continue
        v = np.array([np.concatenate([_index(_slot(w)) / 2, context[_slot(w)]]) for w in words])
        mean = v.mean(0)
        want = np.concatenate([mean, v.std(0), np.mean([_index(_shape(w)) / 2 for w in words], 0), [np.log1p(len(words)), np.linalg.norm(mean)]])
        assert np.abs(x - want).max() < 2e-3


def _plain_features(text, insults):
    """Clauses read word by word by the four transducers, then the text's four numbers."""
    seeds = {w: s for s, line in tg.SEEDS.items() for w in line.split()}
    low = tg.fold(t.LOWER[np.frombuffer((text or "").encode(), np.uint8)]).tobytes().decode()
    clauses, words = defaultdict(list), 0
    for m in re.finditer("[a-z'\x80-\U0010FFFF]+", low):
        word, words = m[0], words + 1
        symbol, weight = 0, 0.0
        if word in seeds:
            symbol, weight = seeds[word], tg.THREAT_WEIGHT if seeds[word] == tg.THREAT else 0.0
        elif word.encode() in insults:
            symbol, weight = tg.INSULT, insults[word.encode()]
        for n in (4, 5, 6):
            x = insults.get(b"^" + word[:n].encode()) if len(word) >= n else None
            if x is not None and symbol in (0, tg.INSULT) and (symbol == 0 or x > weight):
                symbol, weight = tg.INSULT, x
        if symbol:
            clauses[len(re.findall("[.,;:!?\n()\"]", low[:m.start()]))].append((symbol, weight))
    scores = []
    for own in clauses.values():
        states, total = [0] * 4, 0.0
        for symbol, weight in own:
            factor = 1.0
            for k, machine in enumerate((tg.NEGATING, tg.REPORTING, tg.TARGETING, tg.THREATENING)):
                states[k], f = machine.get((states[k], symbol), (states[k], 1.0))
                factor *= f
            total += weight * factor
        if total * tg.FINAL_TARGET[states[2]] > 0:
            scores.append(total * tg.FINAL_TARGET[states[2]])
    return [1.0, max(scores, default=0.0), np.log1p(sum(scores)), sum(scores) / np.sqrt(1.0 + words)]


def test_scores_of_whole_texts_equal_reading_word_by_word(spark):
    insults = {b"fool": 4.0, b"^schur": 3.0, b"clown": 2.5, b"^clow": 2.6, "été".encode(): 1.5, b"^foolis": 5.0}
    grammar = tg.Grammar(insults, np.array([-2.0, 0.5, 0.2, 0.7]))
    rng = random.Random(1)
    pool = ["you", "Fool", "foolish", "not", "said", "kill", "Schurke", "clown", "clowns", "ÉTÉ", "and", "they", "x", "don't", "töten", "the"]
    texts = [None, "", "you", "kill"] + ["".join(rng.choice(pool) + rng.choice([" ", " ", ", ", ". ", "\n", "! (", '"']) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in tg.score(docs, grammar).collect()}
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.dot(_plain_features(text, insults), grammar.layer))), abs=1e-9), text


def test_lexicon_is_the_log_odds_of_words_and_stems(spark):
    rows = [("bad fool here", 1)] * 6 + [("you Fool", 1)] * 2 + [("nice day here", 0)] * 9 + [("a fool once", 0)]
    counts = Counter(y for _, y in rows)
    got = tg.learn_lexicon(spark.createDataFrame(rows, "text string, y int"), counts)
    want = {}
    for f in {f for x, _ in rows for w in x.lower().split() for f in tg.word_stems(w.encode())}:
        n = [sum(f in {g for w in x.lower().split() for g in tg.word_stems(w.encode())} for x, y in rows if y == k) for k in (0, 1)]
        odds = np.log((n[1] + 0.5) / (counts[1] + 1)) - np.log((n[0] + 0.5) / (counts[0] + 1))
        if n[1] >= tg.LEAST_ROWS and odds >= tg.LEAST_ODDS:
            want[f] = odds
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-12 for f in want)
