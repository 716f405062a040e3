"""Substring dedup of word windows with prefix-partitioned suffix trees.

Words covered by a window of ``width`` words whose sequence also starts earlier (smaller document, or the
same one further ahead) are removed; windows are judged on the input. Documents are dealt by anchors (see
``anchored``), and inside a group the suffixes are split by prefixes of growing length until each part fits
``most`` suffixes. Every part's suffix tree (suffix order and common prefix lengths, down to ``width``
words) has the repeats as its internal nodes of that depth; the earliest leaf of a node stays.

Cases: a null or empty text has no words; texts shorter than a window keep all; rows with the same id and
text count as one document; other columns are ignored. Words are compared by 64-bit hashes, ``width`` in a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from regionmatch.llm import anchored as an
from regionmatch.llm import text as t

WIDTH, GRAM, MOST, SLICE = 20, 8, 50_000, 4 << 20


def word_tokens(data: np.ndarray, offsets: np.ndarray):
    starts, ends, row = t.words(data, offsets)
    return t.hashes(data, starts, ends), row, np.searchsorted(row, np.arange(len(offsets) - 1))


def prefix_parts(tokens: np.ndarray, starts: np.ndarray, depth: int, most: int):
    """Parts of the suffixes, each at most ``most`` or equal in all ``depth`` tokens: (suffixes, common prefix)."""
    stack = [(np.arange(len(starts)), 0)]
    while stack:
        own, length = stack.pop()
        if len(own) <= most or length == depth:
            if len(own) > 1:
                yield own, length
            continue
        key = tokens[starts[own] + length]
        order = np.argsort(key, kind="stable")
        cuts = np.append(np.flatnonzero(an._heads(key[order])), len(own))
        small: list[np.ndarray] = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > most:
                stack.append((own[order[a:b]], length + 1))
            elif b - a > 1:
                small.append(own[order[a:b]])
        held, size = [], 0
        for part in [*small, None]:
            if part is None or size + len(part) > most:
                if held:
                    yield np.concatenate(held), length
                held, size = [], 0
            if part is not None:
                held.append(part)
                size += len(part)


class SuffixTree:
    """Leaves in suffix order and the depth of the node that joins each leaf to the one before."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, depth: int):
        cols = [tokens[starts + j] for j in range(depth)]
        self.leaves = np.lexsort(cols[::-1])
        same = np.ones(len(starts), bool)
        same[:1] = False
        self.joined = np.zeros(len(starts), np.int64)
        for c in cols:
            s = c[self.leaves]
            same[1:] &= s[1:] == s[:-1]
            self.joined += same

    def deep_nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf of every internal node of at least ``depth``: the maximal repeats."""
        first, end = t.runs(self.joined >= depth)
        return first - 1, end - 1


def repeats(tokens: np.ndarray, count: np.ndarray, p: dict, width: int = WIDTH, most: int = MOST):
    """(segment, window) of every window of a group that repeats an earlier one."""
    base = np.concatenate([[0], np.cumsum(count + width - 1)[:-1]])
    which = np.repeat(np.arange(len(count)), count)
    offset = t.spread(np.zeros(len(count), np.int64), count)
    starts, place = base[which] + offset, p["first"][which].astype(np.int64) + offset
    doc, crc = p["doc"][which], p["crc"][which]
    out = []
    for own, _ in prefix_parts(tokens, starts, width, most):
        tree = SuffixTree(tokens, starts[own], width)
        first, last = tree.deep_nodes(width)
        size = last - first + 1
        leaves = own[tree.leaves[t.spread(first, size)]]
        node = np.repeat(np.arange(len(first)), size)
        order = np.lexsort((place[leaves], crc[leaves], doc[leaves], node))
        leaves, node = leaves[order], node[order]
        lead = leaves[np.maximum.accumulate(np.where(an._heads(node), np.arange(len(node)), 0))] if len(node) else leaves
        out.append(leaves[(doc[leaves] != doc[lead]) | (crc[leaves] != crc[lead]) | (place[leaves] != place[lead])])
    gone = np.concatenate(out) if out else np.empty(0, np.int64)
    return which[gone], offset[gone]


def cut_words(data: np.ndarray, offsets: np.ndarray, spans: list[list[bytes]], width: int = WIDTH):
    """Per row: words, removed words, and the kept words joined by one blank (flat bytes and offsets)."""
    n = len(offsets) - 1
    starts, ends, row = t.words(data, offsets)
    per = np.bincount(row, minlength=n)
    base = np.concatenate([[0], np.cumsum(per)])
    gone = np.zeros(len(starts), bool)
    for k, own in enumerate(spans):
        if own:
            gone[base[k]:base[k + 1]] = an.mask(int(per[k]), own, width)
    kept = np.flatnonzero(~gone)
    size = ends[kept] - starts[kept]
    joins = np.ones(len(kept), np.int64)
    joins[:-1][row[kept][1:] != row[kept][:-1]] = 0
    joins[-1:] = 0
    at = np.concatenate([[0], np.cumsum(size + joins)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    out[t.spread(at[:-1], size)] = data[t.spread(starts[kept], size)]
    left = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=n))])
    return per, np.bincount(row[gone], minlength=n), out, at[left]


def _with_spans(docs: DataFrame, id_column: str, text_column: str, width: int, k: int, hot: int) -> DataFrame:
    """All columns of ``docs`` and the spans of each row's repeated windows."""

    def find(tokens, count, p):
        return repeats(tokens, count, p, width)

    keyed = an.doc_columns(docs, id_column, text_column)
    spans = an.repeated_windows(keyed, word_tokens, np.uint64, find, width, k, False, SLICE, hot)
    key, crc = F.coalesce(docs[id_column].cast("long"), F.lit(an.LAST)), F.crc32(F.coalesce(docs[text_column], F.lit("")))
    spans = spans.select(F.col("doc").alias("__doc"), F.col("crc").alias("__crc"), F.col("spans").alias("__spans"))
    return docs.withColumns({"__key": key, "__sum": crc}).join(spans, (F.col("__key") == F.col("__doc")) & (F.col("__sum") == F.col("__crc")), "left").drop("__key", "__sum", "__doc", "__crc")


def dedup_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, k: int = GRAM, hot: int = an.HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one blank), kept_sha256 of every row."""
    both = _with_spans(docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")), "doc_id", "text", width, k, hot)
    both = both.select(F.col("doc_id").cast("long"), "text", F.col("__spans").alias("spans"))

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text", SLICE):
            per, gone, out, cuts = cut_words(data, offsets, [s or [] for s in rows.column(2).to_pylist()], width)
            raw = out.tobytes()
            texts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "n_words": per.astype(np.int64), "n_removed": gone.astype(np.int64),
                                              "kept_text": pa.array(texts, pa.binary()).view(pa.string()), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in texts]})

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def cut_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size_column: str = "n_chars", width: int = WIDTH, k: int = GRAM, hot: int = an.HOT) -> DataFrame:
    """``docs`` with repeated passages cut from the text (kept words joined by one blank); a text without any
    stays as it is. The size column, where there is one, follows a changed text."""
    names = docs.columns
    both = _with_spans(docs, id_column, text_column, width, k, hot)
    at = both.columns.index("__spans")

    def run(batches):
        for rows, data, offsets in t.slices(batches, text_column, SLICE):
            spans = [s or [] for s in rows.column(at).to_pylist()]
            _, gone, out, cuts = cut_words(data, offsets, spans, width)
            raw = out.tobytes()
            texts = [raw[a:b] if g else None for a, b, g in zip(cuts[:-1], cuts[1:], gone)]
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(rows.columns) if i != at], pa.array(texts, pa.binary()).view(pa.string())], names=[*[n for n in rows.schema.names if n != "__spans"], "__cut"])

    schema = StructType([*[f for f in both.schema.fields if f.name != "__spans"], StructField("__cut", StringType())])
    cut = both.mapInArrow(run, schema)
    if size_column in names:
        size = F.when(F.col("__cut").isNotNull(), F.length("__cut").cast(docs.schema[size_column].dataType)).otherwise(F.col(size_column))
        cut = cut.withColumn(size_column, size)
    return cut.withColumn(text_column, F.coalesce("__cut", text_column)).select(*names)
