"""Benchmark decontamination with an FM-index per training shard.

Documents are cut into shards of at most SHARD bytes (or one longer row) inside their tasks. Each
shard gets an FM-index over its words: suffix array by prefix doubling (document ends are distinct
separators, so no match crosses them), Burrows-Wheeler transform, wavelet matrix for ranks and text
positions sampled every SAMPLE words. All benchmark windows step backwards through the index together;
their occurrences are located by walking to a sampled position, and the hit words are merged to spans.

Documents are not shuffled. Items are cut to windows in tasks; the table of (window, item) is dealt by hash to blocks
of about BLOCK rows, which differ by their standard deviation only, however long an item is and however many
items share a window. One block is searched at a time: the driver holds and broadcasts that block alone, and
what it found is written before the next one. Several blocks' findings are merged by document.

Cases: null and empty texts have no words; an item without words has no window; items with a null id
are left out; texts that share an item id count as one item; repeated rows are each judged; an empty
benchmark hits nothing. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionmatch.llm import text as t
from regionmatch.llm.staging import written

WINDOW, SHARD, SAMPLE, BLOCK = 13, 4 << 20, 16, 1 << 17
_BITS = 21


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the contamination rule, its row, and words per row."""
    low = t.LOWER[data]
    starts, ends, row = t.words(low, offsets, t.PLAIN)
    return t.hashes(low, starts, ends), row, np.bincount(row, minlength=len(offsets) - 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again.

    The last symbol must be unique. Rank, next rank and place are packed in one 64-bit key.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    packed, width = n <= 1 << _BITS, 1
    size = np.diff(np.append(np.flatnonzero(head), n))
    live = order[np.repeat(size, size) > 1]
    while len(live):
        after = rank[live + width]
        if packed:
            key = (rank[live].astype(np.uint64) << t.U(2 * _BITS)) | (after.astype(np.uint64) << t.U(_BITS)) | np.arange(len(live), dtype=np.uint64)
            key.sort()
            by = (key & t.U((1 << _BITS) - 1)).astype(np.int64)
        else:
            by = np.lexsort((after, rank[live]))
        live = live[by]
        base, after = rank[live], after[by]
        top = np.concatenate([[True], base[1:] != base[:-1]])
        cut = top | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(live))
        group = np.maximum.accumulate(np.where(top, at, 0))
        sub = np.maximum.accumulate(np.where(cut, at, 0))
        rank[live] = base + sub - group
        size = np.diff(np.append(np.flatnonzero(cut), len(live)))
        live = live[np.repeat(size, size) > 1]
        width *= 2
    order[rank] = np.arange(n)
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit plane a level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.planes, cur = bits, [], symbols.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            bit = (cur >> level) & 1
            ones = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.planes.append((ones, len(cur) - int(ones[-1])))
            up = bit.astype(bool)
            cur = np.concatenate([cur[~up], cur[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start, end = np.zeros_like(at), at
        for level, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.planes):
            up = (symbol >> level) & 1 == 1
            start = np.where(up, zeros + ones[start], start - ones[start])
            end = np.where(up, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Index over the words of a shard's rows: count and locate phrases of word hashes."""

    def __init__(self, words: np.ndarray, row: np.ndarray, per_row: np.ndarray, sample: int = SAMPLE):
        docs = len(per_row)
        self.vocabulary, symbol = np.unique(words, return_inverse=True)
        place = np.arange(len(words)) + row
        n = len(words) + docs
        text = np.empty(n, np.int64)
        text[place] = symbol + docs
        self.stops = np.cumsum(per_row + 1) - 1
        text[self.stops] = np.arange(docs)
        suffixes = suffix_array(text)
        bwt = text[suffixes - 1] - docs + 1
        self.bwt = np.maximum(bwt, 0)
        self.before = docs + np.concatenate([[0, 0], np.cumsum(np.bincount(symbol, minlength=len(self.vocabulary)))])
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(len(self.vocabulary)).bit_length()))
        mark = suffixes % sample == 0
        mark |= self.bwt[np.arange(n)] == 0
        self.marks = np.concatenate([[0], np.cumsum(mark)])
        self.samples = suffixes[mark]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each word hash, 0 if the shard lacks it."""
        if not len(self.vocabulary):
            return np.zeros(words.shape, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of phrases (one a line, equal lengths): (phrase, low, high) of those that occur."""
        s = self.symbols(phrases)
        who = np.flatnonzero((s > 0).all(1))
        low, high = self.before[s[who, -1]], self.before[s[who, -1] + 1]
        for j in range(s.shape[1] - 2, -1, -1):
            c = s[who, j]
            low = self.before[c] + self.wavelet.rank(c, low)
            high = self.before[c] + self.wavelet.rank(c, high)
            live = low < high
            who, low, high = who[live], low[live], high[live]
        return who, low, high

    def locate(self, line: np.ndarray) -> np.ndarray:
        """Text place of each line of the suffix array: step back until a sampled place."""
        out, step = np.empty(len(line), np.int64), 0
        live, at = np.arange(len(line)), line
        while len(live):
            found = self.marks[at + 1] > self.marks[at]
            out[live[found]] = self.samples[self.marks[at[found]]] + step
            live, at = live[~found], at[~found]
            c = self.bwt[at]
            at = self.before[c] + self.wavelet.rank(c, at)
            step += 1
        return out


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (words, item_id) of every window of every item: the words' hashes as bytes."""

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text"):
            words, _, per = plain_words(data, offsets)
            first, found, who = np.concatenate([[0], np.cumsum(per)]), [], []
            for k in np.flatnonzero(per):
                own, m = words[first[k]:first[k + 1]], min(window, int(per[k]))
                found += [own[i:i + m].tobytes() for i in range(len(own) - m + 1)]
                who += [k] * (len(own) - m + 1)
            yield pa.RecordBatch.from_pydict({"words": pa.array(found, pa.binary()), "item_id": rows.column(0).take(pa.array(who, pa.int64()))})

    return items.select("item_id", "text").mapInArrow(run, "words binary, item_id string").distinct()


class Phrases:
    """Windows of a block by length, with the items of each."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        self.names = sorted({name for _, name in rows})
        number = {name: k for k, name in enumerate(self.names)}
        found: dict[int, dict[bytes, list[int]]] = {}
        for words, name in rows:
            found.setdefault(len(words) // 8, {}).setdefault(bytes(words), []).append(number[name])
        self.by_length = {}
        for m, own in found.items():
            lists = [sorted(v) for v in own.values()]
            self.by_length[m] = (np.frombuffer(b"".join(own), np.uint64).reshape(-1, m), np.concatenate([[0], np.cumsum([len(v) for v in lists])]), np.array([x for v in lists for x in v]))


def search_shard(data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """Per row: words, hit mask over all words, and (row, item) pairs."""
    words, row, per_row = plain_words(data, offsets)
    hit, pairs = np.zeros(len(words), bool), []
    if len(words) and phrases.by_length:
        index = FMIndex(words, row, per_row)
        for m, (table, cuts, items) in phrases.by_length.items():
            who, low, high = index.search(table)
            place = index.locate(t.spread(low, high - low))
            which = np.repeat(who, high - low)
            doc = np.searchsorted(index.stops, place)
            hit |= t.covered(len(words), place - doc, np.full(len(place), m))
            many = cuts[which + 1] - cuts[which]
            pairs.append(np.unique(np.repeat(doc, many) * len(phrases.names) + items[t.spread(cuts[which], many)]))
    return per_row, row, hit, np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)


_SCHEMA = "doc_id long, row_key long, n_words long, n_hit long, spans array<struct<first:long,last:long>>, items array<string>"


def _search(docs: DataFrame, shared, shard: int) -> DataFrame:
    """What the broadcast block finds in each row."""

    def run(batches):
        own = shared.value
        for rows, data, offsets in t.slices(batches, "text", shard):
            per_row, row, hit, pairs = search_shard(data, offsets, own)
            n, base = len(per_row), np.concatenate([[0], np.cumsum(per_row)])
            edge = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            prev = np.concatenate([[False], hit[:-1]]) if len(row) else hit
            first = np.flatnonzero(hit & (edge | ~prev))
            last = np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]])) if len(row) else first
            cut = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=n))]).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(first - base[row[first]]), pa.array(last - base[row[first]])], ["first", "last"]))
            who, what = np.divmod(pairs, max(1, len(own.names)))
            icut = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))]).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(icut), pa.array([own.names[k] for k in what], pa.string()))
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "row_key": rows.column(1), "n_words": per_row.astype(np.int64),
                                              "n_hit": np.bincount(row[hit], minlength=n).astype(np.int64), "spans": spans, "items": items})

    return docs.mapInArrow(run, _SCHEMA)


def _merge(found: DataFrame) -> DataFrame:
    """Join what several blocks found in one document; equal rows are one."""
    got = found.groupBy("doc_id", "row_key").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                                                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                spans = row.column(3).flatten()
                first, last = (spans.field(k).to_numpy() for k in (0, 1))
                hit = t.covered(int(last.max()) + 1 if len(last) else 0, first, last - first + 1)
                start, end = t.runs(hit)
                merged = pa.ListArray.from_arrays(pa.array([0, len(start)], pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end - 1)], ["first", "last"]))
                yield pa.RecordBatch.from_pydict({"doc_id": row.column(0), "row_key": row.column(1), "n_words": row.column(2), "n_hit": [int(hit.sum())], "spans": merged, "items": row.column(4)})

    return got.select("doc_id", "row_key", "n_words", "spans", "items").mapInArrow(run, _SCHEMA)


def _found(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, window: int, shard: int, block: int) -> tuple[DataFrame, bool]:
    """Findings of every row, or of every different row where there are several blocks."""
    context = docs.sparkSession.sparkContext
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = written(windows_of(items, window))
    blocks = max(1, -(-windows.count() // block))
    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(docs[text_column]).alias("row_key"), docs[text_column].alias("text"))
    every = None
    for k in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == k)
        shared = context.broadcast(Phrases([(r[0], r[1]) for r in own.collect()]))
        found = _search(picked, shared, shard)
        if blocks == 1:
            return found, False
        found = written(found)
        shared.unpersist()
        every = found if every is None else every.unionByName(found)
    return _merge(every), True


def _same(id_column, text_column):
    return id_column.cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_column) == F.col("__key"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Per row: words, hit words, merged spans of hit words (first and last, from 0) and the item ids found (sorted strings)."""
    every, merged = _found(docs, benchmark, id_column, text_column, window, shard, block)
    if not merged:
        return every
    own = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    found = every.withColumnsRenamed({"doc_id": "__id", "row_key": "__key"})
    return own.join(found, _same(F.col("doc_id"), F.col("text"))).select("doc_id", F.col("__key").alias("row_key"), "n_words", "n_hit", "spans", "items")


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, name: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``docs`` with the contract's verdict in a further column ``name``, which ``docs`` must not have yet."""
    every, _ = _found(docs, benchmark, id_column, text_column, window, shard, block)
    verdict = every.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), contaminated().alias(name)).dropDuplicates(["__id", "__key"])
    return docs.join(verdict, _same(docs[id_column], docs[text_column])).drop("__id", "__key")


def contaminated():
    """The contract's rule: any hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
