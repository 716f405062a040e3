"""Quality classifier on random-indexing word vectors.

Every word falls into one of SLOTS hash slots. A slot owns a sparse random index vector; its context
vector is the sum of the index vectors of its neighbours over all occurrences in the whole corpus
(random indexing). A document is the mean and spread of its words' vectors (index and context) and the
mean of the index vectors of their shapes. A network of two layers in numpy, fitted on a bounded sample
of labelled rows, and a temperature fitted on rows of that sample kept aside, give the probability.

The context table has a fixed size (SLOTS x DIMS), so it is summed by slot with partial sums per task
and shipped to the tasks whatever the corpus size.

Cases: null and empty texts pool to zeros and are scored by the network like any text; repeated rows get
equal scores; an empty table gives an empty result; without labelled rows of both classes every score is
the labelled share (0.5 without any). Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionmatch.llm import labels as lab
from regionmatch.llm import text as t

SLOTS, DIMS, ONES = 1 << 14, 32, 4
#: Labelled rows that the network is fitted on, at most.
ROWS = 20_000
WINDOW = 2
_SLICE = 512 << 10


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of each slot's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (SLOTS, ONES)), rng.choice([-1, 1], (SLOTS, ONES))


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> t.U(50)).astype(np.int64)


_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[0x80:] = 1, 2, 3, 2
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 4
_KIND[ord("!")] = 5


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A slot for the kinds of a word's first two and last two bytes and its length class."""
    key = np.zeros(len(starts), np.uint64)
    for at in (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), ends - 1):
        key = key * t.U(8) + _KIND[data[at]].astype(np.uint64)
    length = np.minimum(np.log2(ends - starts + 1).astype(np.uint64), t.U(15)) if len(starts) else key
    return slots(t.mix(key * t.U(16) + length + t.U(1 << 40)))


def context_table(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """SLOTS x DIMS sums of neighbours' index vectors over the whole corpus."""
    where, sign = index_vectors()

    def run(batches):
        table = np.zeros(SLOTS * DIMS)
        for _, data, offsets in t.slices(batches, "text"):
            starts, ends, row = t.words(data, offsets)
            s = slots(t.hashes(data, starts, ends))
            for d in range(1, WINDOW + 1):
                near = np.flatnonzero(row[d:] == row[:-d]) if len(row) > d else np.empty(0, np.int64)
                a, b = s[near], s[near + d]
                for me, other in ((a, b), (b, a)):
                    for k in range(ONES):
                        table += np.bincount(me * DIMS + where[other, k], sign[other, k], SLOTS * DIMS)
        own = table.reshape(SLOTS, DIMS).astype(np.int64)
        live = np.flatnonzero(np.abs(own).sum(1))
        yield pa.RecordBatch.from_pydict({"slot": live.astype(np.int32), **{f"d{i}": own[live, i] for i in range(DIMS)}})

    cols = [f"d{i}" for i in range(DIMS)]
    part = docs.select(F.col(text_column).alias("text")).mapInArrow(run, "slot int, " + ", ".join(f"{c} long" for c in cols))
    got = part.groupBy("slot").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    table = np.zeros((SLOTS, DIMS), np.float32)
    table[got["slot"].to_numpy()] = got[cols].to_numpy(np.float64)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return table / np.where(norm > 0, norm, 1)


class Pooler:
    """Word vectors by slot: index vector and context vector side by side."""

    def __init__(self, context: np.ndarray):
        where, sign = index_vectors()
        index = np.zeros((SLOTS, DIMS), np.float32)
        np.add.at(index, (np.arange(SLOTS)[:, None], where), sign)
        self.index = index / 2
        self.vectors = np.concatenate([self.index, context.astype(np.float32)], 1)
        self.width = 4 * DIMS + DIMS + 2

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        out = np.zeros((n, self.width), np.float32)
        starts, ends, row = t.words(data, offsets)
        count = np.bincount(row, minlength=n)
        live = np.flatnonzero(count)
        if len(live):
            first = np.concatenate([[0], np.cumsum(count[live])[:-1]])
            per = count[live][:, None].astype(np.float32)
            v = self.vectors[slots(t.hashes(data, starts, ends))]
            mean = np.add.reduceat(v, first, 0) / per
            square = np.add.reduceat(v * v, first, 0) / per
            shape = np.add.reduceat(self.index[shapes(data, starts, ends)], first, 0) / per
            spread = np.sqrt(np.maximum(square - mean * mean, 0))
            size = np.log1p(per)
            out[live] = np.concatenate([mean, spread, shape, size, np.linalg.norm(mean, axis=1, keepdims=True)], 1)
        return out


class Network:
    """Two layers: tanh hidden units, one logit; standardised inputs; a temperature."""

    def __init__(self, share: float = 0.5):
        self.parts, self.temperature, self.share = None, 1.0, share

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), np.log(self.share / (1 - self.share)))
        mean, std, w1, b1, w2, b2 = self.parts
        return np.tanh(((x - mean) / std) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        aside, own = order[: len(x) // 5], order[len(x) // 5:]
        mean, std = x[own].mean(0), x[own].std(0) + 1e-3
        z = ((x - mean) / std).astype(np.float64)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        step = 0
        for _ in range(epochs):
            rng.shuffle(own)
            for i in range(0, len(own), 128):
                b = own[i:i + 128]
                h = np.tanh(z[b] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) / len(b)
                back = g[:, None] * p[2] * (1 - h * h)
                grads = [z[b].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], g.sum(keepdims=True)]
                step += 1
                for k, grad in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.parts = (mean, std, *p)
        if len(aside):
            logit, target = self.logits(x[aside]), y[aside]
            grid = np.geomspace(0.25, 8, 61)
            loss = [np.mean(np.logaddexp(0, logit / q) - target * logit / q) for q in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        return self


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[Pooler, Network]:
    """Context vectors from all documents, network from at most ``rows`` labelled rows that may teach."""
    pooler = Pooler(context_table(docs))
    sample = lab.training_sample(labels, "quality", rows=rows)
    share = (sum(y for _, y in sample) + 1) / (len(sample) + 2)
    if len({y for _, y in sample}) < 2:
        return pooler, Network(share)

    def features(batches):
        for own, data, offsets in t.slices(batches, "text", _SLICE):
            x = pooler.features(data, offsets)
            yield pa.RecordBatch.from_pydict({"y": own.column(own.schema.get_field_index("y")), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = lab.only(docs.select("doc_id", "text"), sample).select("text", "y").mapInArrow(features, "y int, x binary").toPandas()
    if got["y"].nunique() < 2:
        return pooler, Network(share)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1)
    return pooler, Network(share).fit(x, got["y"].to_numpy(float))


def score(docs: DataFrame, pooler: Pooler, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Probability of good quality for every row; one narrow pass."""

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text", _SLICE):
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "score": network.probability(pooler.features(data, offsets)).astype(np.float64)})

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double")
