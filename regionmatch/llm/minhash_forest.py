"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles is at least 0.8.

1. Texts with equal shingle sets are one node, numbered by the hash of the set; all further work is on nodes.
   Ids are labels only, so different texts may share one or have none.
2. Each node has TREES x DEPTH minimum hashes. A tree is the trie of its DEPTH hashes. ``least_depth`` is the
   longest prefix at which TREES trees still find a pair at the threshold with the target recall. A trie node at
   that prefix with at most LEAF members gives all its pairs.
3. The members of larger trie nodes are compared block by block on one byte a hash, and those that the signatures
   do not rule out (more than four standard errors below the threshold) are joined to groups (``_groups``). All
   pairs of a group are then verified block by block on whole shingle sets (``_counted``). A task gives each
   member's number of links and one link for each class it joins, so no group is expanded into rows for pairs.
4. Pairs of small trie nodes that lie in no common group, and that signatures do not rule out, are verified on
   whole shingle sets. Sets are dealt by groups of nodes that pairs connect, large groups block by block, so no
   set is sent once a pair. Verified links are joined to classes.

So every pair that meets in a trie node is compared, whatever the node's size, and counted once.

Result, one row per row of the input: doc_id, class_id (smallest doc_id of the class), n_links (other rows
with an equal shingle set, plus the rows of every text with a verified link to this one), n_class_texts
(different texts of the class).

``keep_one`` gives the rows of the input with one row of each class.

Cases: a text of one to four words has one shingle, all its words; null and empty texts have none, are
linked to nothing and form a class of their own (class_id = doc_id, also when null); a null id counts as the
largest; repeated rows are copies; rows that share an id, or have none, are linked by their own texts each.
Other columns are ignored. Node numbers have 64 bits: n different sets share one with a chance of n * n / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionmatch.llm import text as t
from regionmatch.llm.staging import written

NGRAM, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, LEAF = 16, 8, 0.9995, 16
#: Members of a block of signatures; members and shingles of a block of whole sets.
SIGNED, WHOLE, SHINGLES = 8192, 1024, 1 << 21
LAST = (1 << 63) - 1
_RNG = np.random.default_rng(17)
_MUL = _RNG.integers(0, 1 << 63, TREES * DEPTH).astype(np.uint64) * t.U(2) + t.U(1)


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest prefix with which the trees find a pair at the threshold with the wanted probability."""
    return max((k for k in range(1, depth + 1) if 1 - (1 - threshold**k) ** trees >= recall), default=1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    starts, ends, row = t.words(data, offsets)
    h = t.hashes(data, starts, ends)
    rows = len(offsets) - 1
    per = np.bincount(row, minlength=rows)
    base = np.concatenate([[0], np.cumsum(per)])
    grams = t.rolling(h, n)
    out = []
    for k in range(rows):
        if per[k] >= n:
            out.append(np.unique(grams[base[k]:base[k + 1] - n + 1]))
        elif per[k]:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[base[k]:base[k + 1]].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, 32 bits each."""
    out = np.empty(len(_MUL), np.uint32)
    step = max(1, (1 << 17) // max(len(shingles), 1))
    for i in range(0, len(_MUL), step):
        out[i:i + step] = ((shingles[None, :] * _MUL[i:i + step, None]) >> t.U(32)).min(1)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc, body (hash of the text), node (number of the shingle set), number of shingles and signature of every row."""

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text"):
            sets = shingle_sets(data, offsets)
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc": rows.column(0), "body": rows.column(1), "node": pa.array(node, mask=np.array([not len(s) for s in sets], bool)),
                "size": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())})

    return docs.select("doc", "body", "text").mapInArrow(run, "doc long, body long, node long, size long, sig binary")


def _forest(nodes: DataFrame, low: int) -> DataFrame:
    """(node, trie): a row for each node and tree, with the key of its prefix of ``low`` hashes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, TREES, DEPTH).astype(np.uint64)
                key = np.broadcast_to(t.mix(np.arange(1, TREES + 1, dtype=np.uint64)), sig.shape[:2]).copy()
                for d in range(low):
                    key = t.mix(key * t.U(0x9E3779B97F4A7C15) + sig[:, :, d] + t.U(1))
                yield pa.RecordBatch.from_pydict({"node": np.repeat(part.column(0).to_numpy(), TREES), "trie": key.ravel().view(np.int64)})

    return nodes.select("node", "sig").mapInArrow(run, "node long, trie long")


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of nodes that meet in a small trie node, and the members (trie, n, node) of the
    large ones."""
    live = _forest(nodes, least_depth(threshold, recall=recall))
    sizes = written(live.groupBy("trie").agg(F.count("*").alias("n")).filter("n > 1"))
    met = written(live.join(sizes.hint("merge"), "trie"))
    few = met.filter(F.col("n") <= leaf).groupBy("trie").agg(F.sort_array(F.collect_set("node")).alias("m"))
    few = few.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, leaf)).alias("b"))
    return written(few.filter("a < b").distinct()), met.filter(F.col("n") > leaf)


def _least_like(threshold: float) -> float:
    """Signature similarity that a pair at the threshold falls below with a chance of a few in a million."""
    return threshold - 4.5 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5


def _like(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity that two rows of one byte a hash suggest."""
    return ((x == y).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _short(nodes: DataFrame) -> DataFrame:
    """(node, b8): signatures of one byte a hash."""

    def bytes_of(batches):
        for batch in batches:
            own = [np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"node": batch.column(0), "b8": pa.array(own, pa.binary())})

    return written(nodes.select("node", "sig").mapInArrow(bytes_of, "node long, b8 binary"))


def _estimated(pairs: DataFrame, small: DataFrame, threshold: float) -> DataFrame:
    """Pairs without those that their signatures rule out."""
    n, least = TREES * DEPTH, _least_like(threshold)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(t.buffer(batch.column(i))[0], np.uint8).reshape(-1, n) for i in (2, 3))
            keep = _like(x, y) >= least
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]})

    one = small.select(F.col("node").alias("a"), F.col("b8").alias("x")).hint("merge")
    two = small.select(F.col("node").alias("b"), F.col("b8").alias("y")).hint("merge")
    return written(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _joined(label: np.ndarray, k: int, hits: np.ndarray) -> np.ndarray:
    """Puts row k and the hits under one label; returns a hit of each label that k did not have."""
    kinds, at = np.unique(label[hits], return_index=True)
    fresh = hits[at[kinds != label[k]]]
    if len(fresh):
        label[np.isin(label, kinds)] = label[k]
    return fresh


def _block_pairs(members: DataFrame, key: str, blocks) -> DataFrame:
    """The members with the pairs of blocks (i <= j) of their key that they are needed in, and their own block."""
    dealt = members.withColumn("blocks", blocks.cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other").groupBy(key, "i", "j")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the smaller and of the larger block of a pair."""
    own = table.column("own").to_numpy()
    return np.flatnonzero(own == table.column("i")[0].as_py()), np.flatnonzero(own == table.column("j")[0].as_py())


def _groups(large: DataFrame, small: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, class) of members of large trie nodes: two members of a trie node that the signatures do not rule
    out are in one class. Rows already joined are not compared, so a node of near copies costs little."""
    least, n_bytes = _least_like(threshold), TREES * DEPTH

    @t.lean
    def run(table: pa.Table) -> pa.Table:
        node, (left, right) = table.column("node").to_numpy(), _sides(table)
        sig = np.frombuffer(b"".join(table.column("b8").to_pylist()), np.uint8).reshape(-1, n_bytes)
        label, found = np.arange(len(node)), [np.empty((0, 2), np.int64)]
        for k in left:
            rest = right[label[right] != label[k]]
            fresh = _joined(label, k, rest[_like(sig[rest], sig[k]) >= least])
            found.append(np.stack([np.full(len(fresh), node[k]), node[fresh]], 1))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs.min(1), "b": pairs.max(1)})

    held = large.join(small.hint("merge"), "node")
    edges = _block_pairs(held, "trie", F.ceil(F.col("n") / block)).applyInArrow(run, "a long, b long")
    named = classes(written(edges.distinct()))
    return written(named.unionByName(named.select(F.col("class").alias("node"), "class").distinct()))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs that do not lie in one group."""
    one, two = (groups.select(F.col("node").alias(n), F.col("class").alias(f"in_{n}")).hint("merge") for n in ("a", "b"))
    return written(pairs.join(one, "a", "left").join(two, "b", "left").filter(~F.coalesce(F.col("in_a") == F.col("in_b"), F.lit(False))).select("a", "b"))


def _counted(groups: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b, n) from all pairs of each group, verified on whole shingle sets: without b, a has n linked rows in
    a pair of blocks; with b, the two are linked. The links given are those that join the linked nodes."""
    held = written(groups.join(nodes.select("node", "copies", "size").hint("merge"), "node"))
    per = written(held.groupBy("class").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / SHINGLES)).alias("parts")))
    held = held.join(per.hint("merge"), "class").join(sets.hint("merge"), "node")

    @t.lean
    def run(table: pa.Table) -> pa.Table:
        node, copies, (left, right) = table.column("node").to_numpy(), table.column("copies").to_numpy(), _sides(table)
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        base = np.concatenate([[0], np.cumsum(size)])
        flat = ids[t.spread(base[right], size[right])]
        order = np.argsort(flat, kind="stable")
        having = np.repeat(np.arange(len(right)), size[right])[order]
        many = np.bincount(flat, minlength=ids.max() + 1)
        start = np.cumsum(many) - many
        same = len(left) and len(right) and left[0] == right[0]
        label, n, found = np.arange(len(node)), np.zeros(len(node), np.int64), [np.empty((0, 2), np.int64)]
        for k in left:
            own = ids[base[k]:base[k + 1]]
            shared = np.bincount(having[t.spread(start[own], many[own])], minlength=len(right))
            hits = right[shared >= threshold * (size[k] + size[right] - shared) - 1e-9]
            hits = hits[hits != k]
            n[k] += copies[hits].sum()
            if not same:
                n[hits] += copies[k]
            fresh = _joined(label, k, hits)
            found.append(np.stack([np.full(len(fresh), node[k]), node[fresh]], 1))
        pairs, some = np.concatenate(found), n > 0
        return pa.table({"a": pa.array(np.concatenate([node[some], pairs.min(1)])), "b": pa.array([None] * int(some.sum()) + pairs.max(1).tolist(), pa.int64()),
                         "n": pa.array(np.concatenate([n[some], np.zeros(len(pairs), np.int64)]))})

    held = held.select("node", "class", "copies", "shingles", "parts")
    return written(_block_pairs(held, "class", F.col("parts")).applyInArrow(run, "a long, b long, n long"))


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingle sets (sorted 64-bit hashes) of the wanted nodes, from the text of each node's first row."""

    def run(batches):
        for rows, data, offsets in t.slices(batches, "text"):
            yield pa.RecordBatch.from_pydict({"node": rows.column(0), "shingles": pa.array([s.tobytes() for s in shingle_sets(data, offsets)], pa.binary())})

    first = nodes.select("node", "first.*").join(wanted.hint("merge"), "node")
    found = docs.join(first, ["doc", "body"]).select("node", "text").mapInArrow(run, "node long, shingles binary")
    return written(found.groupBy("node").agg(F.max("shingles").alias("shingles")))


def _dealt(near: DataFrame, block: int, buckets: int) -> DataFrame:
    """Pairs with the bucket they are verified in. Nodes that pairs connect form a group; a group is cut into
    blocks of about ``block`` nodes, and a bucket holds whole pairs of blocks, so each set travels once for
    each pair of blocks it is needed in."""
    named = classes(near)
    every = named.unionByName(named.select(F.col("class").alias("node"), "class").distinct())
    size = written(every.groupBy("class").agg(F.count("*").alias("n")))
    placed = written(every.join(size.hint("merge"), "class").select("node", "class", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)).alias("block")))
    one = placed.select(F.col("node").alias("a"), "class", F.col("block").alias("ba")).hint("merge")
    two = placed.select(F.col("node").alias("b"), F.col("block").alias("bb")).hint("merge")
    key = F.pmod(F.xxhash64("class", F.least("ba", "bb"), F.greatest("ba", "bb")), F.lit(buckets)).cast("int")
    return written(near.select("a", "b").join(one, "a").join(two, "b").select("a", "b", key.alias("bucket")))


def _verified(near: DataFrame, sets: DataFrame, threshold: float, buckets: int, block: int = 256) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold."""
    pairs = _dealt(near, block, buckets)
    need = pairs.select(F.col("bucket").alias("deal"), F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = need.join(sets.hint("merge"), "node").select("deal", "node", "shingles")

    @t.lean
    def run(own: pa.Table, with_sets: pa.Table) -> pa.Table:
        nodes = with_sets.column("node").to_numpy()
        order = np.argsort(nodes)
        held = with_sets.column("shingles").combine_chunks()
        a, b = own.column("a").to_numpy(), own.column("b").to_numpy()
        keep = np.zeros(len(a), bool)
        at = [order[np.searchsorted(nodes, v, sorter=order)] if len(nodes) else v for v in (a, b)]
        for i, (j, k) in enumerate(zip(*at)):
            x, y = np.frombuffer(held[int(j)].as_buffer(), np.uint64), np.frombuffer(held[int(k)].as_buffer(), np.uint64)
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = shared >= threshold * (len(both) - shared) - 1e-9
        return pa.table({"a": a[keep], "b": b[keep]})

    return written(pairs.groupBy("bucket").cogroup(sets.groupBy("deal")).applyInArrow(run, "a long, b long"))


def classes(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that the links reach, for linked nodes. Alternating large and small
    stars; every round is written out, and smallest neighbours are found with partial minima."""

    def least(pairs):
        return written(pairs.groupBy("u").agg(F.min("v").alias("m"))).hint("merge")

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        large = written(large)
        low = least(large)
        hang = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(hang.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        # done when every node hangs on one node and none that others hang on hangs itself
        again = edges.select("u", F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1)))
        if not again.groupBy("u").agg(F.sum("n").alias("n")).filter("n > 1").take(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("class"))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc (null ids as the largest), body (hash of the text) and text."""
    return docs.select(F.coalesce(docs[id_column].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(docs[text_column]).alias("body"), docs[text_column].alias("text"))


def _joined_texts(keyed: DataFrame, threshold: float, recall: float, leaf: int, signed_block: int, whole_block: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (node, class, first, n_links) of every different shingle set: its class, its first row
    (doc, body) and the number of other rows that each of its rows is linked to."""
    signed = written(_signed(keyed))
    nodes = written(signed.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("doc", "body")).alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("sig").alias("sig")))
    pairs, large = candidates(nodes, threshold, recall, leaf)
    small = _short(nodes)
    groups = _groups(large, small, threshold, signed_block) if large.take(1) else None
    near = _estimated(pairs if groups is None else _apart(pairs, groups), small, threshold)
    ends = near.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = written((ends if groups is None else ends.unionByName(groups.select("node"))).distinct())
    sets = _sets_of(keyed, nodes, wanted)  # read once for both verifications
    counted = None if groups is None else _counted(groups, nodes, sets, threshold, whole_block)
    links = _verified(near, sets, threshold, max(64, wanted.count() // 1000))
    named = classes(links if counted is None else written(links.unionByName(counted.filter("b is not null").select("a", "b")).distinct()))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    many = nodes.select(F.col("node").alias("b"), "copies").hint("merge")
    degree = ends.join(many, "b").select("a", F.col("copies").alias("n"))
    if counted is not None:
        degree = degree.unionByName(counted.filter("b is null").select("a", "n"))
    degree = degree.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    texts = nodes.join(named.hint("merge"), "node", "left").join(written(degree).hint("merge"), "node", "left")
    return signed, texts.select("node", F.coalesce("class", "node").alias("class"), "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF,
                 signed_block: int = SIGNED, whole_block: int = WHOLE) -> DataFrame:
    """doc_id, class_id, n_links, n_class_texts of every row."""
    signed, texts = _joined_texts(_keyed(docs, id_column, text_column), threshold, recall, leaf, signed_block, whole_block)
    size = written(texts.groupBy("class").agg(F.count("*").alias("n_class_texts"), F.min("first.doc").alias("class_id")))
    named = written(texts.select("node", "class", "n_links").join(size.hint("merge"), "class").drop("class"))
    own = signed.select("doc", "node").join(named.hint("merge"), "node", "left")
    back = lambda c: F.when(c != LAST, c)
    return own.select(back(F.col("doc")).alias("doc_id"), back(F.coalesce("class_id", "doc")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_class_texts", F.lit(1)).cast("long").alias("n_class_texts"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id, and all rows without a word. Rows that share
    an id, or have none, are told apart by their texts."""
    signed, texts = _joined_texts(_keyed(docs, id_column, text_column), threshold, recall, LEAF, SIGNED, WHOLE)
    first = texts.groupBy("class").agg(F.min("first").alias("first")).select("first.*").withColumn("once", F.lit(True))
    wordless = signed.filter("node is null").select("doc", "body").distinct().withColumn("once", F.lit(False))
    chosen = written(first.unionByName(wordless)).select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), "once").withColumnRenamed("once", "__once")
    names = docs.columns
    kept = docs.join(chosen.hint("merge"), (F.coalesce(docs[id_column].cast("long"), F.lit(LAST)) == F.col("__doc")) & (F.xxhash64(docs[text_column]) == F.col("__body")))
    some = kept.filter("__once").dropDuplicates(["__doc", "__body"])
    return some.unionByName(kept.filter("not __once")).select(*names)
