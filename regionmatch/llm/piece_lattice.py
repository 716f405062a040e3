"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice whose edges are vocabulary pieces (blanks written as the piece mark, one blank put in
front) or single bytes of characters that have no piece. Forward Viterbi scores of every lattice node are
exact estimates of what a path still costs to the start, so a backward A* search from the end pops the best
N segmentations in order.

The lattice falls apart at every place that no piece spans (known from the vocabulary). Distinct parts of a
slice are scored once, all together in numpy, with their best and second best score. In the best N
segmentations of a text only the N-1 parts with the least loss can leave their best path, so A* runs over
the joined lattice of those.

Scores: a unigram model's own; a BPE model has only merge ranks, which stand for Zipf's law,
p(rank) = 1 / (rank * H). Decoding gives back the exact text.

Cases: null and empty texts have no pieces, one segmentation of score 0, and decode to the empty text;
repeated rows are encoded alike; equal scores are ordered by the search, which depends on the text alone;
texts with fewer than N segmentations give all they have. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from regionmatch.llm import text as t

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 4
LOCKSTEP = 64
_BASE = t.U(0x100000001B3 * 0x9E37 + 2)
_NONE = -1e18


class Vocabulary:
    """Pieces as bytes (mark replaced by a blank), scores, and the places where the lattice can be cut."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, ids: np.ndarray, bytes_ids: np.ndarray, byte_score: float, surface: list[bytes]):
        self.scores, self.bytes_ids, self.byte_score = scores, bytes_ids, byte_score
        self.by_piece = {p: (int(i), float(s)) for p, i, s in zip(pieces, ids, scores[ids])}
        self.lengths = sorted({len(p) for p in pieces})
        lengths = np.array([len(x) for x in surface])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at, self.surface_n = np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths
        self.joined = np.zeros((129, 129), bool)
        for p in pieces:
            k = np.minimum(np.frombuffer(p, np.uint8), 128)
            self.joined[k[:-1], k[1:]] = True
        self.joined[128, 128] = True
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.first, self.second = np.full(1 << 20, -1, np.int32), np.full(1 << 20, -1, np.int32)
        self.key = np.zeros(len(scores), np.uint64)
        for i, x in zip(ids, h):
            self.key[i] = x
            a, b = (int(s[0]) for s in self._slots(np.array([x], np.uint64)))
            table, at = (self.first, a) if self.first[a] < 0 else (self.second, b)
            if table[at] >= 0:
                raise ValueError("piece table overflow")
            table[at] = i

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for b in p:
            h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    @staticmethod
    def _slots(h):
        return (h * t.U(0x9E3779B97F4A7C15)) >> t.U(44), (h * t.U(0xD6E8FEB86659FD93)) >> t.U(44)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 if none."""
        a, b = self._slots(h)
        i = self.first[a.astype(np.int64)]
        good = (i >= 0) & (self.key[i] == h)
        j = self.second[b.astype(np.int64)]
        return np.where(good, i, np.where((j >= 0) & (self.key[j] == h), j, -1))


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    mark = "▁"
    surface, scores = [b""] * n, np.zeros(n)
    bytes_ids = np.full(256, sp.unk_id(), np.int64)
    ids = []
    for i in range(n):
        name = sp.id_to_piece(i)
        scores[i] = sp.get_score(i)
        if sp.is_byte(i):
            bytes_ids[int(name[3:5], 16)] = i
            surface[i] = bytes([int(name[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            surface[i] = name.replace(mark, " ").encode()
            ids.append(i)
    ids = np.array(ids)
    own = scores[ids]
    if np.array_equal(own, np.floor(own)) and own.min() < -1000:
        rank = np.argsort(np.argsort(-own, kind="stable")) + 1
        scores[ids] = -np.log(rank) - np.log(np.sum(1.0 / np.arange(1, len(ids) + 1)))
    byte_score = float(scores[ids].min() - 1)
    scores[np.setdiff1d(np.arange(n), ids)] = byte_score
    return Vocabulary([surface[i] for i in ids], scores, ids, bytes_ids, byte_score, surface)


def _char_size(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def edges(part: bytes, vocabulary: Vocabulary) -> list[list[tuple[int, int, float]]]:
    """Edges into each node of a part's lattice: (from, id, score)."""
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(part) + 1)]
    at = 0
    while at < len(part):
        size = int(_char_size(np.uint8(part[at])))
        for n in vocabulary.lengths:
            hit = vocabulary.by_piece.get(part[at:at + n]) if at + n <= len(part) else None
            if hit:
                into[at + n].append((at, *hit))
        if part[at:at + size] not in vocabulary.by_piece:
            for k in range(at, min(at + size, len(part))):
                into[k + 1].append((k, int(vocabulary.bytes_ids[part[k]]), vocabulary.byte_score))
        at += size
    return into


def forward(into) -> list[float]:
    """Best score of any path from the start to each node."""
    alpha = [0.0] + [_NONE] * (len(into) - 1)
    for e in range(1, len(into)):
        alpha[e] = max((alpha[s] + x for s, _, x in into[e]), default=_NONE)
    return alpha


def n_best(into, n: int) -> list[tuple[float, list[int]]]:
    """The best n paths by backward A*; the forward scores are the heuristic, which is exact."""
    alpha, out = forward(into), []
    heap, order = [(-alpha[-1], 0, len(into) - 1, 0.0, None)], 0
    while heap and len(out) < n:
        _, _, node, score, tail = heapq.heappop(heap)
        if node == 0:
            ids = []
            while tail is not None:
                ids.append(tail[0])
                tail = tail[1]
            out.append((score, ids))
            continue
        for s, i, x in into[node]:
            if alpha[s] > _NONE / 2:
                order += 1
                heapq.heappush(heap, (-(score + x + alpha[s]), order, s, score + x, (i, tail)))
    return out


def _second(into) -> tuple[float, float, list[int]]:
    best = n_best(into, 2)
    return best[0][0], best[1][0] if len(best) > 1 else _NONE, best[0][1]


def viterbi(data: np.ndarray, starts: np.ndarray, size: np.ndarray, vocabulary: Vocabulary):
    """Best and second best score of every part and the piece ids of the best path, end to end."""
    n = len(starts)
    best, second, pieces = np.empty(n), np.empty(n), np.zeros(n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    for high in (4, 8, 12, 20, 32, LOCKSTEP):
        own = np.flatnonzero((size > low) & (size <= high))
        low = high
        for i in range(0, len(own), 100_000):
            which = own[i:i + 100_000]
            best[which], second[which], pieces[which], ids = _lockstep(data, starts[which], size[which], vocabulary)
            found.append((which, ids))
    for k in np.flatnonzero(size > LOCKSTEP):
        best[k], second[k], ids = _second(edges(data[starts[k]:starts[k] + size[k]].tobytes(), vocabulary))
        pieces[k] = len(ids)
        found.append((np.array([k]), np.array(ids, np.int64)))
    at = np.concatenate([[0], np.cumsum(pieces)])
    flat = np.empty(int(at[-1]), np.int32)
    for which, ids in found:
        flat[t.spread(at[which], pieces[which])] = ids
    return best, second, pieces, at[:-1], flat


def _lockstep(data, starts, size, v: Vocabulary):
    """Viterbi with two scores a node over parts of similar length, one node after another for all parts."""
    n, width = len(starts), int(size.max())
    place = starts[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    byte = np.where(inside, data[np.minimum(place, len(data) - 1)], 0)
    found = {}
    h = np.zeros((n, width), np.uint64)
    for length in range(1, min(width, v.lengths[-1]) + 1):
        h = h[:, : width - length + 1] * _BASE + byte[:, length - 1:].astype(np.uint64) + t.U(1)
        if length in v.lengths:
            hit = v.find(h)
            hit[~inside[:, length - 1:]] = -1
            if (hit >= 0).any():
                found[length] = hit
    unknown = np.zeros((n, width), bool)
    for length in range(1, min(4, width) + 1):
        lead = inside & (byte & 0xC0 != 0x80) & (_char_size(byte) == length)
        lead = lead[:, : width - length + 1]
        bare = lead & (found[length] < 0) if length in found else lead
        for k in range(length):
            unknown[:, k:width - length + 1 + k] |= bare
    one = found.get(1, np.full((n, width), -1, np.int32))
    found[1] = np.where(one >= 0, one, np.where(unknown & inside, v.bytes_ids[byte], -1))
    a, b = np.full((n, width + 1), _NONE), np.full((n, width + 1), _NONE)
    back = np.zeros((n, width + 1), np.int8)
    a[:, 0] = 0
    for e in range(1, width + 1):
        for length, hit in found.items():
            if length > e:
                continue
            ids = hit[:, e - length]
            gain = np.where(ids >= 0, v.scores[ids], 2 * _NONE)
            one, two = a[:, e - length] + gain, b[:, e - length] + gain
            np.maximum(b[:, e], np.maximum(np.minimum(a[:, e], one), two), out=b[:, e])
            up = one > a[:, e]
            back[up, e] = length
            a[up, e] = one[up]
    rows = np.arange(n)
    at, steps, live_steps = size.copy(), [], []
    while (at > 0).any():
        length = back[rows, at].astype(np.int64)
        ids = np.full(n, -1, np.int64)
        for k, hit in found.items():
            own = np.flatnonzero((length == k) & (at > 0))
            ids[own] = hit[own, at[own] - k]
        steps.append(ids)
        live_steps.append(at > 0)
        at = np.where(at > 0, at - length, 0)
    grid, live = np.stack(steps[::-1], 1), np.stack(live_steps[::-1], 1)
    return a[rows, size], np.maximum(b[rows, size], _NONE), live.sum(1), grid[live]


def cut_parts(data: np.ndarray, offsets: np.ndarray, v: Vocabulary):
    """Texts with a blank in front, cut where no piece spans: (bytes, part starts, part sizes, row of each)."""
    n = len(offsets) - 1
    full = np.diff(offsets) > 0
    shift = np.cumsum(full)
    out = np.full(len(data) + int(full.sum()), 0x20, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + shift[row]] = data
    first = (offsets[:-1] + np.concatenate([[0], shift[:-1]]))[full]
    kind = np.minimum(out, 128)
    cut = np.ones(len(out), bool)
    cut[1:] = ~v.joined[kind[:-1], kind[1:]]
    cut[first] = True
    starts = np.flatnonzero(cut)
    size = np.diff(np.append(starts, len(out)))
    return out, starts, size, np.flatnonzero(full)[np.searchsorted(first, starts, "right") - 1] if len(starts) else starts


class Encoder:
    """Encodes slices; keeps a bounded store of part lattices between them."""

    def __init__(self, vocabulary: Vocabulary, best: int = BEST, keep: int = 50_000):
        self.v, self.best, self.keep, self.store = vocabulary, best, keep, {}

    def _edges(self, part: bytes):
        got = self.store.get(part)
        if got is None:
            if len(self.store) >= self.keep:
                self.store.clear()
            got = self.store[part] = edges(part, self.v)
        return got

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Per row: piece ids (flat), number of pieces, and the best segmentations as (score, edits)."""
        n = len(offsets) - 1
        out, starts, size, row = cut_parts(data, offsets, self.v)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(n, np.int64), [[(0.0, [])] for _ in range(n)]
        _, first, which = np.unique(t.hashes(out, starts, starts + size), return_index=True, return_inverse=True)
        best, second, pieces, at, flat = viterbi(out, starts[first], size[first], self.v)
        ids = flat[t.spread(at[which], pieces[which])]
        per_row = np.bincount(row, pieces[which], n).astype(np.int64)
        total = np.bincount(row, best[which], n)
        loss = (best - second)[which]
        per = np.bincount(row, minlength=n)
        cuts = np.concatenate([[0], np.cumsum(per)])
        done = np.concatenate([[0], np.cumsum(pieces[which])])
        result = []
        for k in range(n):
            lo, hi = cuts[k], cuts[k + 1]
            own = np.arange(lo, hi)
            if hi - lo > self.best - 1:
                least = np.partition(loss[lo:hi], self.best - 2)[self.best - 2]
                below = own[loss[lo:hi] < least]
                own = np.sort(np.concatenate([below, own[loss[lo:hi] == least][: self.best - 1 - len(below)]]))
            own = own[loss[own] < -_NONE / 2]
            plain = [ids[done[p]:done[p + 1]].tolist() for p in own]
            result.append(self._alternatives(out, starts, size, own, best[which[own]].sum(), total[k], plain, done[own] - done[lo]))
        return ids, per_row, result

    def _alternatives(self, out, starts, size, parts, own_best, total, plain, at):
        """Best segmentations of a text by A* over the joined lattices of the parts that may change. Among equal
        scores the Viterbi path (``plain``) comes first."""
        if not len(parts):
            return [(float(total), [])]
        into, ends = [[]], []
        for p in parts:
            base = len(into) - 1
            into += [[(s + base, i, x) for s, i, x in own] for own in self._edges(out[starts[p]:starts[p] + size[p]].tobytes())[1:]]
            ends.append(len(into) - 1)
        result = [(float(total), [])]
        for score, ids in n_best(into, self.best):
            edits = [(int(a), len(old), new) for a, new, old in zip(at, self._split(ids, ends), plain) if new != old]
            if edits:
                result.append((float(total + score - own_best), edits))
        return result[: self.best]

    def _split(self, ids: list[int], ends: list[int]) -> list[list[int]]:
        out, own, at, k = [], [], 0, 0
        for i in ids:
            own.append(i)
            at += int(self.v.surface_n[i])
            if at == ends[k]:
                out.append(own)
                own, k = [], k + 1
        return out


def encode(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text", best: int = BEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids of the best segmentation, and ``segmentations``: the best N as score and edits of the ids
    (at, drop, put), the first without edits; the columns named in ``keep`` go along. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    edit = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))

    def run(batches):
        coder = Encoder(shared.value, best)
        for rows, data, offsets in t.slices(batches, "text", 1 << 20):
            ids, per_row, found = coder.encode(data, offsets)
            cut = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
            segs = [[{"score": s, "edits": [{"at": a, "drop": d, "put": p} for a, d, p in e]} for s, e in own] for own in found]
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(segs, kind), *rows.columns[2:]], names=["doc_id", "ids", "segmentations", *keep])

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"), *[docs[c].alias(f"kept_{i}") for i, c in enumerate(keep)])
    along = [StructField(c, f.dataType) for c, f in zip(keep, picked.schema.fields[2:])]
    kinds = "ids array<int>, segmentations array<struct<score:double,edits:array<struct<at:int,drop:int,put:array<int>>>>>"
    return picked.mapInArrow(run, StructType([StructField("doc_id", LongType()), *StructType.fromDDL(kinds).fields, *along]))


def decode_ids(flat: np.ndarray, cuts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that the id lists stand for."""
    n = v.surface_n[flat]
    data = v.surface[t.spread(v.surface_at[flat], n)]
    ends = np.concatenate([[0], np.cumsum(n)])[cuts]
    full = ends[1:] > ends[:-1]
    keep = np.ones(len(data), bool)
    keep[ends[:-1][full]] = False
    return data[keep], ends - np.concatenate([[0], np.cumsum(full)])


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_column: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text that the ids stand for; other columns are kept."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    at = encoded.columns.index(ids_column)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = part.column(at)
                lists = lists.fill_null([]) if lists.null_count else lists
                cuts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
                data, offsets = decode_ids(np.asarray(lists.flatten()), cuts, shared.value)
                texts = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(run, schema)


def summary(encoded: DataFrame) -> DataFrame:
    """Per row: pieces of the best segmentation and the scores and sizes of the best N."""
    sizes = F.transform("segmentations", lambda s: F.size("ids") + F.aggregate(s["edits"], F.lit(0), lambda a, e: a + F.size(e["put"]) - e["drop"]))
    return encoded.withColumns({"n_pieces": F.size("ids"), "scores": F.col("segmentations.score"), "sizes": sizes})
