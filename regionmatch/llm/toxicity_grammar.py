"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, report, or nothing. Four small transducers
(negation, reported speech, target, threat) read a clause's symbols and pass each insult or threat
on with a factor; their product automaton is built once by composition, and the final state adds a
factor for the clause. A clause's score is the weighted sum of what it emits, so a word counts by
the clause it stands in.

Insult weights are log-odds of words and word stems (leading 4 to 6 letters) learned from a bounded,
balanced sample of labelled rows; a logistic layer over clause totals gives the probability.

Cases: null and empty texts have no clause and get the score of no evidence; repeated rows are scored
alike; an empty table gives an empty result; without any labelled row of either class there is no
insult lexicon and the layer's default weights apply. Only the id and text columns are read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from regionmatch.llm import labels as lab
from regionmatch.llm import text as t

#: Rows of either class that the lexicon and the layer are fitted on, at most.
PER_CLASS = 8000
#: Least log-odds, least share of toxic rows and most entries of the learned lexicon.
LEAST_ODDS, LEAST_ROWS, MOST_ENTRIES = 2.5, 4, 20000
INSULT, THREAT, TARGET, NEGATION, REPORT = range(1, 6)
#: Seed symbols, fixed values: common words of the four languages of the corpora.
SEEDS = {
    THREAT: "kill hurt destroy beat stab shoot burn töten schlagen verletzen tuer frapper brûler matar golpear quemar",
    TARGET: "you your yours they them he she him her du dich dein euch ihr sie tu te toi vous ton ta tú ti usted ustedes ellos",
    NEGATION: "not no never nobody isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says wrote claimed called quoted sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
}
THREAT_WEIGHT = 2.0
#: (next state, factor) by (state, symbol); absent pairs keep the state and pass with factor 1.
NEGATING = {(0, NEGATION): (1, 1.0), (1, INSULT): (0, 0.3), (1, THREAT): (0, 0.3)}
REPORTING = {(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.5), (1, THREAT): (1, 0.5)}
TARGETING = {(0, TARGET): (1, 1.0)}
THREATENING = {(0, TARGET): (1, 1.0), (0, THREAT): (0, 0.2)}
FINAL_TARGET = (0.8, 1.0)
_WORD = re.compile(rb"[^\x00-\x26\x28-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LETTERS[0x27] = True
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n()\"")] = True


def compose(*machines: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]:
    """Product of two-state transducers: next state and factor by (state, symbol), and the states."""
    states = list(itertools.product((0, 1), repeat=len(machines)))
    move, factor = np.zeros((len(states), 6), np.int64), np.ones((len(states), 6))
    for i, state in enumerate(states):
        for symbol in range(6):
            steps = [m.get((s, symbol), (s, 1.0)) for m, s in zip(machines, state)]
            move[i, symbol] = states.index(tuple(s for s, _ in steps))
            factor[i, symbol] = np.prod([f for _, f in steps])
    return move, factor, states


MOVE, FACTOR, STATES = compose(NEGATING, REPORTING, TARGETING, THREATENING)
FINAL = np.array([FINAL_TARGET[s[2]] for s in STATES])


def clause_scores(symbols: np.ndarray, weights: np.ndarray, clause: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score of every clause that has symbols. ``clause`` is non-decreasing; all clauses step together."""
    ids, first, count = np.unique(clause, return_index=True, return_counts=True)
    state, total = np.zeros(len(ids), np.int64), np.zeros(len(ids))
    live, step = np.arange(len(ids)), 0
    while len(live):
        at = first[live] + step
        total[live] += weights[at] * FACTOR[state[live], symbols[at]]
        state[live] = MOVE[state[live], symbols[at]]
        step += 1
        live = live[count[live] > step]
    return ids, total * FINAL[state]


def word_stems(word: bytes) -> list[bytes]:
    """The word and its leading 4, 5 and 6 letters (whole code points)."""
    text = word.decode("utf-8", "replace")
    return [word] + [b"^" + text[:n].encode() for n in (4, 5, 6) if len(text) >= n]


def _lexicon_hashes(entries: dict[bytes, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted word hashes with symbol and weight of the whole-word entries."""
    names = list(entries)
    data = np.frombuffer(b"".join(names), np.uint8)
    ends = np.cumsum([len(n) for n in names]).astype(np.int64)
    h = t.hashes(data, ends - np.array([len(n) for n in names]), ends)
    order = np.argsort(h)
    return h[order], np.array([entries[names[i]][0] for i in order], np.int64), np.array([entries[names[i]][1] for i in order])


class Grammar:
    """A fitted lexicon and layer; small, bounded by MOST_ENTRIES, and shipped with the tasks."""

    def __init__(self, insults: dict[bytes, float], layer: np.ndarray):
        seeds = {w.encode(): (s, THREAT_WEIGHT if s == THREAT else 0.0) for s, line in SEEDS.items() for w in line.split()}
        plain = {w: (INSULT, x) for w, x in insults.items() if w[:1] != b"^"}
        stems = {w[1:]: (INSULT, x) for w, x in insults.items() if w[:1] == b"^"}
        self.words = _lexicon_hashes(plain | seeds)
        self.stems = {n: _lexicon_hashes(own) for n in (4, 5, 6) if (own := {w: v for w, v in stems.items() if len(w.decode("utf-8", "replace")) == n})}
        self.layer = layer

    def symbols(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbol, weight = np.zeros(len(starts), np.int64), np.zeros(len(starts))

        def look(table, h, which):
            keys, s, w = table
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = (keys[at] == h) & ((symbol[which] == 0) | (w[at] > weight[which]))
            symbol[which[hit]], weight[which[hit]] = s[at[hit]], w[at[hit]]

        if len(starts):
            look(self.words, t.hashes(data, starts, ends), np.arange(len(starts)))
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            place = np.searchsorted(lead, starts)
            stop = np.concatenate([lead, np.full(8, len(data))])
            for n, table in self.stems.items():
                cut = stop[place + n]
                which = np.flatnonzero((cut <= ends) & (symbol == 0) | (cut <= ends) & (symbol == INSULT))
                look(table, t.hashes(data, starts[which], cut[which]), which)
        return symbol, weight

    def clauses(self, data: np.ndarray, offsets: np.ndarray):
        """(row, first byte, last byte, score) of the clauses that emit anything, and words per row."""
        low = t.LOWER[data]
        low = fold(low)
        starts, ends, row = t.words(low, offsets, LETTERS)
        symbol, weight = self.symbols(low, starts, ends)
        at = np.flatnonzero(symbol)
        border = np.concatenate([[0], np.cumsum(ENDS[data])])
        key = border[starts] + row
        ids, score = clause_scores(symbol[at], weight[at], key[at])
        first = np.searchsorted(key[at], ids)
        last = np.searchsorted(key[at], ids, "right") - 1
        keep = score > 0
        return row[at[first]][keep], starts[at[first]][keep], ends[at[last]][keep], score[keep], np.bincount(row, minlength=len(offsets) - 1)

    def features(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        row, first, last, score, words = self.clauses(data, offsets)
        top = np.zeros(n)
        np.maximum.at(top, row, score)
        total = np.bincount(row, score, n)
        x = np.stack([np.ones(n), top, np.log1p(total), total / np.sqrt(1.0 + words)], 1)
        return x, (row, first, last, score)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.layer, -30, 30)))


def fold(low: np.ndarray) -> np.ndarray:
    """Lower-case the two-byte Latin capitals À to Þ as well."""
    if not (low == 0xC3).any():
        return low
    out = low.copy()
    second = np.flatnonzero(low[:-1] == 0xC3) + 1
    b = low[second]
    out[second] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(sample: DataFrame, counts: dict[int, int]) -> dict[bytes, float]:
    """Log-odds of words and stems, counted once a row; partial counts leave each task."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, y in zip(t.column(batch, "text").to_pylist(), batch.column(batch.schema.get_field_index("y")).to_pylist()):
                low = fold(t.LOWER[np.frombuffer(text.encode(), np.uint8)]).tobytes()
                own = {f for w in set(_WORD.findall(low)) if len(w) <= 64 for f in word_stems(w)}
                seen.update((f, y) for f in own)
            if len(seen) > 500_000:
                yield _pairs(seen)
                seen = Counter()
        yield _pairs(seen)

    total = (
        sample.select("text", "y").mapInArrow(count, "f binary, toxic long, clean long")
        .groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("odds", F.log((F.col("toxic") + 0.5) / (counts[1] + 1)) - F.log((F.col("clean") + 0.5) / (counts[0] + 1)))
        .filter((F.col("toxic") >= LEAST_ROWS) & (F.col("odds") >= LEAST_ODDS))
        .orderBy(F.desc("odds"), "f").limit(MOST_ENTRIES)
    )
    return {bytes(r.f): r.odds for r in total.collect()}


def _pairs(seen: Counter) -> pa.RecordBatch:
    names = list(seen)
    n = np.array([seen[k] for k in names], np.int64)
    y = np.array([k[1] for k in names], np.int64) if names else n
    return pa.RecordBatch.from_pydict({"f": pa.array([k[0] for k in names], pa.binary()), "toxic": n * (y == 1), "clean": n * (y == 0)})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Grammar:
    """Lexicon and layer from at most ``per_class`` rows of either label that may teach."""
    sample = lab.training_sample(labels, "toxic", per_class=per_class)
    counts = Counter(y for _, y in sample)
    default = np.array([-3.0, 0.6, 0.0, 0.6])
    if min(counts[0], counts[1]) == 0:
        return Grammar({}, default)
    rows = lab.only(docs.select("doc_id", "text"), sample)
    grammar = Grammar(learn_lexicon(rows, counts), default)

    def features(batches):
        for own, data, offsets in t.slices(batches, "text"):
            x, _ = grammar.features(data, offsets)
            yield pa.RecordBatch.from_pydict({"y": own.column(own.schema.get_field_index("y")), **{f"x{i}": x[:, i] for i in range(4)}})

    got = rows.select("text", "y").mapInArrow(features, "y int, x0 double, x1 double, x2 double, x3 double").toPandas()
    if got.empty:
        return grammar
    x, y = got[["x0", "x1", "x2", "x3"]].to_numpy(), got["y"].to_numpy(float)
    grammar.layer = logistic(x, y)
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Probability, number of matched clauses and their byte spans for every row; one narrow pass."""

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text"):
            x, (row, first, last, points) = grammar.features(data, offsets)
            n = len(offsets) - 1
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays(
                [pa.array(first - offsets[row]), pa.array(last - offsets[row]), pa.array(points)], ["first", "last", "score"]))
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "score": grammar.probability(x), "clauses": spans})

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, clauses array<struct<first:long,last:long,score:double>>")


def score_column(docs: DataFrame, grammar: Grammar, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability in a further column ``name``, which ``docs`` must not have yet."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name} already")
    at = docs

    def run(batches):
        for batch in batches:
            for rows, data, offsets in t.slices([batch], text_column):
                x, _ = grammar.features(data, offsets)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(grammar.probability(x))], names=[*rows.schema.names, name])

    return at.mapInArrow(run, StructType([*at.schema.fields, StructField(name, DoubleType())]))
