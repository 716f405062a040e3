"""Ranked lexical search of all documents by an Aho-Corasick scan, without a document index.

1. ``terms_of``: the terms of each item with their repeats, as a table; ``_blocked`` packs items into blocks of
   at most BLOCK bytes of terms (or one item, which is one row of the table) by running sums.
2. For each block one automaton of all its terms, each between two blanks, is broadcast. A document's text is
   brought to terms between single blanks, so a term counts only where it stands whole, and blanks are shared by
   neighbours. An output of the automaton is the term's number; a sparse table maps terms to items.
3. ``_statistics`` scans once: documents that hold a term, documents and their terms altogether, from which the
   weights follow. ``_ranked`` scans again: scores of all documents for all items of the block as sparse products
   in slices; a task keeps each item's best. No task, group or broadcast grows with the documents.
4. The best of all tasks are ranked by item. Blocks follow one another; a block's broadcast goes with it.

Score of an item: sum over its terms (repeats included) of w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with
w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 25 + (75 * n * N) div L, in whole numbers.

Result: item_id, rank, doc_id, score of each item's ``k`` best documents above 0, ties by ascending doc_id.

Cases: null and empty texts have no terms and are never found; a null doc_id sorts last and comes back as null;
repeated documents are found each by itself; rows of one item_id are one item with the terms of all of its
different texts (equal rows count once), a null item_id is an item like others; empty tables give no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regionmatch.llm import text as t
from regionmatch.llm.staging import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K, BLOCK = 10, 1 << 20
#: (document, item) cells, and products, of a slice of documents.
CELLS, PRODUCTS = 1 << 21, 1 << 22
LAST = (1 << 63) - 1
#: Bytes of a text as bytes of its terms; all that belongs to no term becomes a blank.
SPACED = np.where(t.PLAIN[t.LOWER], t.LOWER, np.uint8(0x20)).astype(np.uint8)


def terms_of(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, term, times) of every item."""
    rows = items.select(items[id_column].alias("item_id"), items[text_column].alias("text")).distinct()
    found = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({TERM})"), F.lit(1))
    return rows.select("item_id", F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _blocked(terms: DataFrame, block: int) -> DataFrame:
    """``terms`` with a block number: items are dealt to buckets by hash, and packed in each bucket by running sums."""
    sizes = written(terms.groupBy("item_id").agg(F.sum(F.octet_length("term") + 1).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(total / block))))
    before = F.sum("size").over(Window.partitionBy("bucket").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1))
    packed = sizes.withColumn("bucket", bucket).withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / block))
    packed = packed.select(F.col("item_id").alias("own"), "bucket", "part").hint("merge")
    return written(terms.join(packed, terms["item_id"].eqNullSafe(packed["own"])).drop("own"))


class Block:
    """The terms of a block's items, and for each term the items that hold it and how often."""

    def __init__(self, rows: list[tuple]):
        self.items = sorted({r[0] for r in rows}, key=lambda i: (i is None, i))
        self.terms = sorted({r[1] for r in rows})
        item, term = {i: k for k, i in enumerate(self.items)}, {w: k for k, w in enumerate(self.terms)}
        at = np.array([term[r[1]] for r in rows], np.int64)
        order = np.argsort(at, kind="stable")
        self.item = np.array([item[r[0]] for r in rows], np.int64)[order]
        self.times = np.array([r[2] for r in rows], np.int64)[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.terms) + 1))

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            found.add_word(f" {term} ", k)
        found.make_automaton()
        return found


def counted(data: np.ndarray, offsets: np.ndarray, automaton, n_terms: int):
    """Terms of each row, and (row, term, tf) of the automaton's terms in it."""
    rows = len(offsets) - 1
    spaced = SPACED[data]
    n = np.bincount(t.words(spaced, offsets, t.PLAIN)[2], minlength=rows)
    raw, keys = spaced.tobytes(), []
    for k in range(rows):
        hits = np.fromiter((v for _, v in automaton.iter(" " + raw[offsets[k]:offsets[k + 1]].decode() + " ")), np.int64)
        keys.append(hits + k * n_terms)
    key, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    return n, key // n_terms, key % n_terms, tf.astype(np.int64)


def _statistics(docs: DataFrame, held) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each term of the block."""

    def run(batches):
        block = held.value
        automaton, n_terms = block.automaton(), len(block.terms)
        df, total, some = np.zeros(n_terms, np.int64), 0, 0
        for _, data, offsets in t.slices(batches, "text"):
            n, _, term, _ = counted(data, offsets, automaton, n_terms)
            df += np.bincount(term, minlength=n_terms)
            total, some = total + int(n.sum()), some + int((n > 0).sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": np.append(seen, [-1, -2]), "n": np.append(df[seen], [some, total])})

    sums = {r[0]: r[1] for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    df = np.array([sums.get(k, 0) for k in range(len(held.value.terms))], np.int64)
    return sums.get(-1, 0), sums.get(-2, 0), df


def weights(some: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The ``k`` best (score, doc) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, item, doc, score):
        keep = (score > 0) & (score >= self.least[item])
        item, doc, score = (np.concatenate([own, new[keep]]) for own, new in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self.k
        self.item, self.doc, self.score = item[kept], doc[kept], score[kept]
        full = (np.arange(len(item)) - first == self.k - 1)
        self.least[item[full]] = score[full]


def _scores(block: Block, row, term, impact, rows: int):
    """(row, item, score) of all rows of a slice that share a term with an item."""
    many = np.diff(block.start)[term]
    cells = np.zeros(rows * len(block.items), np.int64)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), PRODUCTS)) + at)
        own = slice(at, end)
        place = t.spread(block.start[term[own]], many[own])
        np.add.at(cells, np.repeat(row[own] * len(block.items), many[own]) + block.item[place], np.repeat(impact[own], many[own]) * block.times[place])
        at = end
    some = np.flatnonzero(cells)
    return some // len(block.items), some % len(block.items), cells[some]


def _ranked(docs: DataFrame, held, weight: np.ndarray, some: int, total: int, k: int) -> DataFrame:
    """(item, doc, score): the best of each task."""

    def run(batches):
        block = held.value
        automaton, n_terms, n_items = block.automaton(), len(block.terms), len(block.items)
        best = Best(n_items, k)
        for rows, data, offsets in t.slices(batches, "text"):
            n, row, term, tf = counted(data, offsets, automaton, n_terms)
            m = np.array([25 + (75 * int(x) * some) // total if total else 25 for x in n], np.int64)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            ids = rows.column(0).to_numpy()
            step = max(1, CELLS // n_items)
            for at in range(0, len(n), step):
                own = slice(*np.searchsorted(row, [at, at + step]))
                r, item, score = _scores(block, row[own] - at, term[own], impact[own], min(step, len(n) - at))
                best.add(item, ids[r + at], score)
        yield pa.RecordBatch.from_pydict({"item": best.item, "doc": best.doc, "score": best.score})

    return docs.mapInArrow(run, "item long, doc long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
                  k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(docs[id_column].cast("long"), F.lit(LAST)).alias("doc"), docs[text_column].alias("text"))
    terms = _blocked(terms_of(items, item_column, item_text), block)
    kind = terms.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for bucket, part in sorted(tuple(r) for r in terms.select("bucket", "part").distinct().collect()):
        rows = terms.filter((F.col("bucket") == bucket) & (F.col("part") == part)).select("item_id", "term", "times").collect()
        held = spark.sparkContext.broadcast(Block([tuple(r) for r in rows]))
        some, total, df = _statistics(keyed, held)
        found = _ranked(keyed, held, weights(some, df), some, total, k)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
        top = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(held.value.items)), f"item long, item_id {kind}")
        named = top.join(names, "item").select("item_id", "rank", F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "score")
        out = out.unionByName(written(named))
        held.unpersist()
    return out
