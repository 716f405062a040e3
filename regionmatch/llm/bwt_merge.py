"""Substring dedup of byte strings by merging Burrows-Wheeler transforms of shards.

Bytes covered by a ``width``-byte string that also starts in a document with a smaller id are removed;
strings are judged on the input and never cross documents. Documents are dealt by anchors (see
``anchored``). A group is cut between anchors into parts of about PART bytes. In a part, shards of at most
SHARD bytes are sorted on their own; their transforms are
merged by refining an interleave: each round deals the current order stably by the preceding symbols and
carries the borders between blocks of equal prefixes, so after the last round the blocks are the
intervals of suffixes that share ``width`` bytes. No suffix is sorted again.

Cases: a null text is empty; texts shorter than ``width`` keep all; rows with the same id never remove
each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from regionmatch.llm import anchored as an
from regionmatch.llm import text as t
from regionmatch.llm.fm_decontamination import suffix_array

WIDTH, GRAM, SHARD, PART, SLICE = 50, 24, 64 << 10, 256 << 10, 1 << 20
_CODES = t.mix(np.arange(1, 257, dtype=np.uint64) * t.U(0x9E3779B97F4A7C15))


def byte_tokens(data: np.ndarray, offsets: np.ndarray):
    return _CODES[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), offsets[:-1]


class Transform:
    """Burrows-Wheeler transform of strings laid end to end, with one end mark a string.

    ``symbol``: what stands before each suffix, in suffix order (0 ends a string, else byte + 1);
    ``back``: the row of the suffix that is longer by it; ``place``: where each suffix starts.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        text = np.empty(len(data) + n, np.int64)
        stops = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(text), bool)
        inside[stops] = False
        text[inside] = data.astype(np.int64) + n
        text[stops] = np.arange(n)
        self.place = suffix_array(text)
        row = np.empty(len(text), np.int32)
        row[self.place] = np.arange(len(text), dtype=np.int32)
        before = text[self.place - 1]
        self.symbol = np.where(before < n, 0, before - n + 1).astype(np.uint16)
        self.back = row[self.place - 1]


def merge(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' rows, right to ``depth`` symbols, and the borders of the blocks that share them.

    An entry of the interleave is a row of a shard (numbered through all shards). A round deals the entries
    stably by the symbols before them and steps each to the longer suffix: two symbols a round, read from
    the transforms, so a round takes the order from p to p + 2 symbols.
    """
    base = np.cumsum([0] + [len(x.symbol) for x in shards[:-1]])
    symbol = np.concatenate([x.symbol for x in shards])
    back = np.concatenate([x.back + b for x, b in zip(shards, base)]).astype(np.int32)
    wide = np.uint16 if symbol.max(initial=0) < 256 else np.uint32
    pair, back2 = (symbol[back].astype(wide) << wide(8 if wide is np.uint16 else 16)) | symbol.astype(wide), back[back]
    row = np.arange(len(symbol), dtype=np.int32)
    border = np.zeros(len(symbol), bool)
    border[:1] = True
    for key, step in [(symbol, back)] * (depth % 2) + [(pair, back2)] * (depth // 2):
        own = key[row]
        order = np.argsort(own, kind="stable")
        s, b = own[order], np.cumsum(border, dtype=np.int32)[order]
        border = np.ones(len(row), bool)
        border[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        row = step[row[order]]
    return row, border


def parts_of(anchor: np.ndarray, sizes: np.ndarray, part: int):
    """Segments cut between anchors into parts of about ``part`` tokens."""
    order = np.argsort(anchor, kind="stable")
    head = an._heads(anchor[order])
    before = np.cumsum(sizes[order]) - sizes[order]
    which = np.maximum.accumulate(np.where(head, before, 0)) // part
    cuts = np.append(np.flatnonzero(an._heads(which)), len(order))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield order[a:b]


def _part_repeats(data: np.ndarray, count: np.ndarray, doc: np.ndarray, width: int, shard_bytes: int):
    """(segment, window) of the repeated windows of one part."""
    sizes = count + width - 1
    ends = np.cumsum(sizes)
    which = (ends - sizes) // shard_bytes
    cuts = np.append(np.flatnonzero(an._heads(which)), len(sizes))
    shards = [Transform(data[ends[a] - sizes[a]:ends[b - 1]], sizes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    row, border = merge(shards, width)
    first = np.cumsum(sizes + 1) - sizes - 1
    place = np.concatenate([x.place + first[a] for x, a in zip(shards, cuts)])[row]
    segment = np.searchsorted(first, place, "right") - 1
    offset = place - first[segment]
    good = offset < count[segment]
    of = doc[segment]
    low = np.minimum.reduceat(np.where(good, of, np.iinfo(np.int64).max), np.flatnonzero(border))[np.cumsum(border) - 1]
    gone = np.flatnonzero(good & (of > low))
    return segment[gone], offset[gone]


def repeats(tokens: np.ndarray, count: np.ndarray, p: dict, width: int = WIDTH, part: int = PART, shard_bytes: int = SHARD):
    """(segment, window) of every window that also lies in a smaller document of the group."""
    sizes = count + width - 1
    base = np.cumsum(sizes) - sizes
    found = []
    for own in parts_of(p["anchor"], sizes, part):
        segment, offset = _part_repeats(tokens[t.spread(base[own], sizes[own])], count[own], p["doc"][own], width, shard_bytes)
        found.append((own[segment], offset))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def dedup_bytes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, k: int = GRAM, hot: int = an.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 of every row."""
    keyed = an.doc_columns(docs, id_column, text_column)

    def find(tokens, count, p):
        return repeats(tokens, count, p, width)

    spans = an.repeated_windows(keyed, byte_tokens, np.uint8, find, width, k, True, SLICE, hot)
    both = keyed.join(spans, ["doc", "crc"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text", SLICE):
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")}
            for own, a, b in zip(rows.column(2).to_pylist(), offsets[:-1], offsets[1:]):
                raw, removed, runs = data[a:b], 0, 0
                if own:
                    gone = an.mask(len(raw), own, width)
                    removed, runs, raw = int(gone.sum()), len(t.runs(gone)[0]), raw[~gone]
                kept = raw.tobytes()
                for name, value in zip(out, (int(b - a), removed, runs, kept, hashlib.sha256(kept).hexdigest())):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), **{n: pa.array(v, pa.int64() if n[1] == "_" else pa.binary() if n == "kept" else pa.string()) for n, v in out.items()}})

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
