"""Repeated windows of tokens over all documents, without sending every window.

A window is ``width`` neighbouring tokens of one document (words or bytes). Its anchor is its leftmost
smallest k-gram by hash, so equal windows have equal anchors at equal places. Neighbouring windows mostly
share their anchor; such a run of windows is a segment. Segments are what is dealt out:

1. ``deal``: every segment goes to a bucket by its anchor as numbers only (anchor, hash of its tokens,
   document, place). Blocks of a slice's segments travel as packed arrays. Of equal segments of a slice only the
   earliest is dealt by its anchor; the others are repeats already and are dealt by their documents, so a passage
   that very many documents share sends one segment a slice.
2. ``compare``: in a bucket, equal segments are settled by their numbers: all but the earliest are
   repeats. Where an anchor has different segments, the earliest of each is asked for its tokens.
3. ``fetch``: the asked tokens are read from their documents and dealt by anchor, or, where an anchor has
   more than ``hot`` different segments, window by window with the whole window as the key, so no group
   grows with a frequent anchor.
4. an operator's own structure (suffix trees, merged transforms) finds the equal windows in each group.
5. ``remove``: per document, all repeated windows are merged and cut out.

A document is (doc_id, crc32 of its text): repeated rows count as one document. A null id sorts last.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionmatch.llm import text as t
from regionmatch.llm.staging import written

_PLACE = 22
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 128
HOT = 20_000
LAST = (1 << 63) - 1


def segments(x: np.ndarray, row: np.ndarray, width: int, k: int):
    """(first window, windows, anchor hash, segment hash) of all segments of a slice's tokens."""
    out, block = [], 1 << (_PLACE - 1)
    for at in range(0, max(len(x) - width + 1, 0), block):
        out.append([a + at if i == 0 else a for i, a in enumerate(_segments(x[at:at + block + width - 1], row[at:at + block + width - 1], width, k))])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _segments(x, row, width, k):
    grams = t.rolling(x, k)
    mask = t.U((1 << _PLACE) - 1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    span, done = width - k + 1, 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    ok = t.whole(row, width)
    anchor = (least & mask).astype(np.int64)
    edge = ok.copy()
    edge[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(edge)
    stop = np.flatnonzero(ok & np.concatenate([edge[1:] | ~ok[1:], [True]])) if len(ok) else first
    w = t.rolling(x, width)
    seg = t.mix(w[first] * t.U(0x9E3779B97F4A7C15) + t.mix(w[stop]) + (stop - first).astype(np.uint64))
    return first, stop - first + 1, grams[anchor[first]], seg


def squeeze(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def doc_columns(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Key columns (doc, crc), the id as given, and the text."""
    text = F.coalesce(docs[text_column], F.lit(""))
    return docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[id_column].cast("long"), F.lit(LAST)).alias("doc"), F.crc32(text).alias("crc"), text.alias("text"))


def bucket_count(docs: DataFrame) -> int:
    """Buckets that keep a bucket's share of the text near BUCKET_BYTES."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, math.ceil(size / BUCKET_BYTES))


#: (bytes, offsets of rows) -> (token hashes, row of each token, first token of each row)
Tokenize = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
_PACK = "bucket int, docs binary, crcs binary, runs binary, first binary, count binary, anchor binary, seg binary"
_ASKED = "doc long, crc long, gone binary, ask binary"


def _pack(which: np.ndarray, groups: int, ids, crcs, row, first, count, anchor, seg):
    """Rows of packed arrays, one a group that has entries; entries keep their order."""
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(groups + 1))
    out = {n: [] for n in ("bucket", "docs", "crcs", "runs", "first", "count", "anchor", "seg")}
    for g in range(groups):
        o = order[cuts[g]:cuts[g + 1]]
        if not len(o):
            continue
        r = row[o]
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out["bucket"].append(g)
        out["docs"].append(squeeze(ids[r[head]]))
        out["crcs"].append(squeeze(crcs[r[head]].astype(np.uint32)))
        out["runs"].append(squeeze(np.diff(np.append(head, len(r))).astype(np.uint32)))
        out["first"].append(squeeze(first[o].astype(np.uint32)))
        out["count"].append(squeeze(count[o].astype(np.uint32)))
        out["anchor"].append(None if anchor is None else anchor[o].tobytes())
        out["seg"].append(None if seg is None else seg[o].tobytes())
    return pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), **{n: pa.array(out[n], pa.binary()) for n in list(out)[1:]}})


def later_copies(anchor, seg, doc, crc, first, across: bool) -> np.ndarray:
    """Which segments of a slice repeat an earlier equal one of the slice, by the rule of ``settle``."""
    order = np.lexsort((first, crc, doc, seg, anchor))
    a, s, d, c, f = anchor[order], seg[order], doc[order], crc[order], first[order]
    lead = np.maximum.accumulate(np.where(_heads(a, s), np.arange(len(a)), 0))
    gone = np.empty(len(a), bool)
    gone[order] = d > d[lead] if across else (d != d[lead]) | (c != c[lead]) | (f != f[lead])
    return gone


def deal(docs: DataFrame, tokenize: Tokenize, width: int, k: int, buckets: int, limit: int, across: bool) -> DataFrame:
    """Packed segments of all documents by bucket; without anchors those that a slice has settled as repeats."""

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text", limit):
            x, row, base = tokenize(data, offsets)
            first, count, anchor, seg = segments(x, row, width, k)
            if not len(first):
                continue
            ids, crcs = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            r = row[first]
            place = first - base[r]
            gone = later_copies(anchor, seg, ids[r], crcs[r], place, across)
            live, gone = np.flatnonzero(~gone), np.flatnonzero(gone)
            yield _pack((t.mix(anchor[live]) % t.U(buckets)).astype(np.int64), buckets, ids, crcs, r[live], place[live], count[live], anchor[live], seg[live])
            if len(gone):
                which = (t.mix(ids[r[gone]].astype(np.int64).view(np.uint64)) % t.U(buckets)).astype(np.int64)
                yield _pack(which, buckets, ids, crcs, r[gone], place[gone], count[gone], None, None)

    return docs.select("doc", "crc", "text").mapInArrow(run, _PACK)


def unpack(table: pa.Table) -> dict[str, np.ndarray]:
    """The entries of packed rows; anchors and hashes of rows that have none are empty."""
    cols = {n: [b for b in table.column(n).to_pylist() if b is not None] for n in table.column_names if n != "bucket"}
    if not table.num_rows:
        kinds = {"doc": np.int64, "crc": np.uint32, "first": np.uint32, "count": np.uint32, "anchor": np.uint64, "seg": np.uint64}
        return {n: np.empty(0, kind) for n, kind in kinds.items()}
    runs = np.concatenate([expand(b, np.uint32) for b in cols["runs"]])
    return {
        "doc": np.repeat(np.concatenate([expand(b, np.int64) for b in cols["docs"]]), runs),
        "crc": np.repeat(np.concatenate([expand(b, np.uint32) for b in cols["crcs"]]), runs),
        "first": np.concatenate([expand(b, np.uint32) for b in cols["first"]]), "count": np.concatenate([expand(b, np.uint32) for b in cols["count"]]),
        "anchor": np.frombuffer(b"".join(cols["anchor"]), np.uint64), "seg": np.frombuffer(b"".join(cols["seg"]), np.uint64),
    }


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where any of the sorted keys changes."""
    edge = np.zeros(len(keys[0]), bool)
    edge[:1] = True
    for a in keys:
        edge[1:] |= a[1:] != a[:-1]
    return edge


def settle(p: dict[str, np.ndarray], across: bool, hot: int):
    """Which segments repeat an earlier equal one, and which are asked for their tokens (1, or 2 if hot).

    ``across``: only an equal segment of a smaller document counts; else also an earlier place.
    """
    order = np.lexsort((p["first"], p["crc"], p["doc"], p["seg"], p["anchor"]))
    anchor, seg, doc, crc, first = (p[n][order] for n in ("anchor", "seg", "doc", "crc", "first"))
    top, sub = _heads(anchor), _heads(anchor, seg)
    n = np.arange(len(anchor))
    lead = np.maximum.accumulate(np.where(sub, n, 0))
    if across:
        gone = doc > doc[lead]
    else:
        gone = (doc != doc[lead]) | (crc != crc[lead]) | (first != first[lead])
    at = np.cumsum(top) - 1
    kinds = np.bincount(at[sub])[at]
    ask = ~gone & (kinds > 1)
    if across:
        low = np.minimum.reduceat(doc, np.flatnonzero(top))[at] if len(doc) else doc
        high = np.maximum.reduceat(doc, np.flatnonzero(top))[at] if len(doc) else doc
        ask &= high > low
    mode = np.zeros(len(anchor), np.uint8)
    mode[ask] = 1 + (kinds[ask] > hot)
    back = np.empty(len(order), np.int64)
    back[order] = n
    return gone[back], mode[back]


def _by_document(doc, crc, gone_rows, ask_rows):
    """Rows (doc, crc, gone, ask) of records grouped by document; both parts as packed bytes."""
    out = {"doc": [], "crc": [], "gone": [], "ask": []}
    order = np.lexsort((crc, doc))
    d, c = doc[order], crc[order]
    cuts = np.append(np.flatnonzero(_heads(d, c)), len(d)) if len(d) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        o = order[a:b]
        g, q = gone_rows[o], ask_rows[o] if ask_rows is not None else None
        g = g[g["count"] > 0]
        out["doc"].append(int(d[a]))
        out["crc"].append(int(c[a]))
        out["gone"].append(g.tobytes())
        out["ask"].append(b"" if q is None else q[q["count"] > 0].tobytes())
    return pa.table({"doc": pa.array(out["doc"], pa.int64()), "crc": pa.array(out["crc"], pa.int64()), "gone": pa.array(out["gone"], pa.binary()), "ask": pa.array(out["ask"], pa.binary())})


SPAN = np.dtype([("first", "<u4"), ("count", "<u4")])
ASK = np.dtype([("anchor", "<u8"), ("first", "<u4"), ("count", "<u4"), ("mode", "u1")])


def compare(dealt: DataFrame, across: bool, hot: int) -> DataFrame:
    """Per document: spans of windows that are settled as repeats, and segments to be fetched."""

    @t.lean
    def run(table: pa.Table) -> pa.Table:
        settled = pc.is_null(table.column("anchor"))
        early, p = unpack(table.filter(settled)), unpack(table.filter(pc.invert(settled)))
        gone, mode = settle(p, across, hot)
        keep = np.flatnonzero(gone | (mode > 0))
        n = len(keep)
        spans, asks = np.zeros(n + len(early["doc"]), SPAN), np.zeros(n + len(early["doc"]), ASK)
        spans["first"][:n], spans["count"][:n] = p["first"][keep], np.where(gone[keep], p["count"][keep], 0)
        spans["first"][n:], spans["count"][n:] = early["first"], early["count"]
        asks["anchor"][:n], asks["first"][:n], asks["mode"][:n] = p["anchor"][keep], p["first"][keep], mode[keep]
        asks["count"][:n] = np.where(mode[keep] > 0, p["count"][keep], 0)
        return _by_document(np.concatenate([p["doc"][keep], early["doc"]]), np.concatenate([p["crc"][keep], early["crc"]]), spans, asks)

    return dealt.groupBy("bucket").applyInArrow(run, _ASKED)


_TOKENS = "bucket int, docs binary, crcs binary, runs binary, first binary, count binary, anchor binary, seg binary, tokens binary"


def fetch(docs: DataFrame, asked: DataFrame, tokenize: Tokenize, token_kind, width: int, groups: int, limit: int) -> DataFrame:
    """Packed segments with their tokens, by group: token hashes, or the bytes themselves where tokens are bytes."""
    wanted = asked.filter(F.length("ask") > 0).groupBy("doc", "crc").agg(F.collect_list("ask").alias("asks"))
    both = docs.join(wanted, ["doc", "crc"]).select("doc", "crc", "text", "asks")

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text", limit):
            x, row, base = tokenize(data, offsets)
            lists = rows.column(3).to_pylist()
            raw = data if token_kind is np.uint8 else x
            asks = [np.frombuffer(b"".join(a), ASK) for a in lists]
            n = np.array([len(a) for a in asks])
            ask, r = np.concatenate(asks), np.repeat(np.arange(len(asks)), n)
            cold = ask["mode"] == 1
            many = np.where(cold, 1, ask["count"]).astype(np.int64)
            first = t.spread(ask["first"].astype(np.int64), many)
            count = np.repeat(np.where(cold, ask["count"], 1).astype(np.int64), many)
            r = np.repeat(r, many)
            at = base[r] + first
            key = np.where(np.repeat(cold, many), np.repeat(ask["anchor"], many), t.rolling(x, width)[at])
            which = (t.mix(key) % t.U(groups)).astype(np.int64)
            batch = _pack(which, groups, rows.column(0).to_numpy(), rows.column(1).to_numpy(), r, first, count, key, key)
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(groups + 1))
            tokens = [squeeze(raw[t.spread(at[o], count[o] + width - 1)]) for g in range(groups) if len(o := order[cuts[g]:cuts[g + 1]])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.binary())], names=[*batch.schema.names, "tokens"])

    return both.mapInArrow(run, _TOKENS)


#: (tokens of all segments, windows of each, their columns) -> (segment, window) of every repeated window
Resolve = Callable[[np.ndarray, np.ndarray, dict], tuple[np.ndarray, np.ndarray]]


def resolve(fetched: DataFrame, width: int, token_kind, find: Resolve) -> DataFrame:
    """Per document: spans of repeated windows that ``find`` sees in a group's tokens."""

    @t.lean
    def run(table: pa.Table) -> pa.Table:
        p = unpack(table.drop_columns(["tokens"]))
        tokens = np.concatenate([expand(b, token_kind) for b in table.column("tokens").to_pylist()])
        which, offset = find(tokens, p["count"].astype(np.int64), p)
        spans = np.zeros(len(which), SPAN)
        spans["first"], spans["count"] = p["first"][which] + offset, 1
        return _by_document(p["doc"][which], p["crc"][which], spans, None)

    return fetched.groupBy("bucket").applyInArrow(run, _ASKED)


def mask(size: int, spans: list[bytes], width: int) -> np.ndarray:
    """Which of a document's tokens lie in a repeated window."""
    s = np.frombuffer(b"".join(spans), SPAN)
    return t.covered(size, s["first"].astype(np.int64), s["count"].astype(np.int64) + width - 1)


def repeated_windows(docs: DataFrame, tokenize: Tokenize, token_kind, find: Resolve, width: int, k: int, across: bool, limit: int, hot: int = HOT) -> DataFrame:
    """(doc, crc, spans): packed spans of every document's windows that repeat an earlier window."""
    buckets = bucket_count(docs)
    asked = written(compare(deal(docs, tokenize, width, k, buckets, limit, across), across, hot))
    found = written(resolve(fetch(docs, asked, tokenize, token_kind, width, buckets, limit), width, token_kind, find))
    every = asked.select("doc", "crc", "gone").unionByName(found.select("doc", "crc", "gone"))
    return every.filter(F.length("gone") > 0).groupBy("doc", "crc").agg(F.collect_list("gone").alias("spans"))
