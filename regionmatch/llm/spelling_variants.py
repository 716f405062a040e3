"""Groups of spelling variants: words one edit apart, found by dynamic programming over sorted lists.

1. ``vocabulary``: words and their numbers over whole texts, combined on the map side.
2. ``_dealt``: two words one edit apart agree before and after the place where they first differ. A window
   [s, e) of places of the shorter word is a guess at that place; a list holds the words of one prefix before
   and one suffix after the window. All words stand in the lists of their two halves. Lists of more than
   MOST words are dealt again by halves of their window, down to windows of one place, whose lists are bounded
   by the alphabet. So no list grows with a frequent beginning or ending, and lists of one word go.
3. ``near_in_lists``: each list is sorted. Words that follow one another share their longest common prefix, so
   a row of the edit matrix (the three cells around the diagonal) is worked out once a query for all words that
   share the prefix, and a range of words goes as soon as no cell of its row is below two. All queries and
   ranges of one depth are one numpy step.
4. A pair counts in the one list whose window holds the place where the two first differ.
5. ``grouped``: the most frequent near word of at least RATIO times a word's count is its form; roots by
   pointer jumping, whose rounds grow with the logarithm of the longest chain (counts double at each step).

Result, one row per word: word, n, n_near, form, form_n, root.

Cases: null and empty texts have no words; a null id counts as the empty string in the typo rule; repeated
rows count again; words of equal n are told apart in code-point order; a word of any length is one word; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionmatch.llm import text as t
from regionmatch.llm.staging import written

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_SIZE, LEAST_COUNT, RATIO = 5, 3, 2
#: One run in TYPO loses a code point; None leaves the runs as they are.
TYPO = 97
#: Words of a list before it is dealt again, words held by a task at once, and pairs worked on at once.
MOST, HELD, FRONT = 2048, 1 << 16, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_typo(doc_id: Column, run: Column, one_in: int = TYPO) -> Column:
    """``run``, or ``run`` without code point h % length where ``one_in`` divides h, the crc32 of '<doc_id>:<run>'."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_size: int = LEAST_SIZE, least_count: int = LEAST_COUNT, typo: int | None = TYPO) -> DataFrame:
    """(word, n) of all words of at least ``least_size`` code points that stand at least ``least_count`` times."""
    runs = docs.select(docs[id_column].alias("doc"), F.explode(F.regexp_extract_all(docs[text_column], F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    run = F.translate("run", _UPPER, _LOWER)
    words = runs.select("doc", run.alias("run")).select((with_typo(F.col("doc"), F.col("run"), typo) if typo else F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_size).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _keyed(words: DataFrame) -> DataFrame:
    """The list key of each row's window: shorter word's length, window, and what stands before and after it."""
    return words.withColumn("list", F.xxhash64("m", "s", "e", F.substr("word", F.lit(1), F.col("s")), F.expr("right(word, m - e)")))


def _halves(m: Column, s: Column, e: Column) -> Column:
    middle = (s + F.ceil((e - s) / 2)).cast("int")
    return F.array(F.struct(m.alias("m"), s.alias("s"), middle.alias("e")), F.struct(m.alias("m"), middle.alias("s"), e.alias("e")))


def _dealt(words: DataFrame, least_size: int, most: int) -> DataFrame:
    """(word, n, m, s, e, list) of all lists of two words or more, none of more than ``most`` unless its window is one place."""
    size = F.length("word")
    ends = words.withColumn("m", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= least_size)))
    level = ends.select("word", "n", F.explode(_halves(F.col("m"), F.lit(0), F.col("m"))).alias("w")).select("word", "n", "w.*")
    done = None
    while True:
        keyed = written(_keyed(level))
        sizes = written(keyed.groupBy("list").agg(F.count("*").alias("members")).filter("members > 1"))
        held = keyed.join(sizes.hint("merge"), "list")
        wide = (F.col("members") > most) & (F.col("e") - F.col("s") > 1)
        fine = held.filter(~wide).select("word", "n", "m", "s", "e", "list")
        done = fine if done is None else done.unionByName(fine)
        if not sizes.filter(F.col("members") > most).take(1):
            return done
        again = held.filter(wide)
        if not again.take(1):
            return done
        level = again.select("word", "n", F.explode(_halves(F.col("m"), F.col("s"), F.col("e"))).alias("w")).select("word", "n", "w.*")


def _common(codes, at, size, left, right) -> np.ndarray:
    """Longest common prefix of each pair of words."""
    out = np.zeros(len(left), np.int64)
    live, d = np.arange(len(left)), 0
    while len(live):
        live = live[(size[left[live]] > d) & (size[right[live]] > d)]
        live = live[codes[at[left[live]] + d] == codes[at[right[live]] + d]]
        out[live] += 1
        d += 1
    return out


def near_in_lists(words: list[str], lists: np.ndarray, shortest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, other) of all pairs one edit apart within a list. ``words`` are sorted within each list; queries are
    the words of the list's shorter length ``shortest``, others have that length or one more."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    n = np.arange(len(words))
    lcp = np.full(len(words), -1, np.int64)
    inner = np.flatnonzero(lists[1:] == lists[:-1]) + 1
    lcp[inner] = _common(codes, at, size, inner - 1, inner)
    node_of = np.cumsum(lcp < 0) - 1  # of each word: its range of words with a common prefix of d code points
    query = n[size == shortest]
    state = (query, node_of[query], np.full(len(query), 2, np.int8), np.zeros(len(query), np.int8), np.ones(len(query), np.int8))
    word, d, found = n, 0, [(n[:0], n[:0])]
    padded = np.append(codes, np.zeros(2, np.uint32))
    while len(state[0]) and len(word):
        node_of, word = node_of[size[word] > d], word[size[word] > d]
        head = lcp[word] <= d
        child_of = np.cumsum(head) - 1  # ranges at depth d + 1, in the order of their parents
        first, parent = word[head], node_of[head]
        letter = codes[at[first] + d]
        whole = size[first] == d + 1  # a word that ends here is the first of its range
        least, most = np.searchsorted(parent, state[1]), np.searchsorted(parent, state[1], "right")
        out, many = [], np.cumsum(most - least)
        cuts = [0, *np.searchsorted(many, np.arange(FRONT, int(many[-1]), FRONT)).tolist(), len(many)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                kept, hits = _row(state, slice(a, b), least, most, d, letter, size, padded, at)
                out.append(kept)
                q, child = hits
                ends = whole[child]
                found.append((q[ends], first[child[ends]]))
        state = tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(x[:0] for x in state)
        node_of, d = child_of, d + 1
    q, other = (np.concatenate(c) for c in zip(*found))
    return q, other


def _row(state, own, least, most, d, letter, size, codes, at):
    """The next row of the matrix of every (query, range of words) of a part of the front: those below two go on,
    with the ranges whose prefix is exactly one edit from the whole query."""
    q, _, b0, b1, b2 = (x[own] for x in state)
    counts = (most - least)[own]
    child = t.spread(least[own], counts)
    q, b0, b1, b2 = (np.repeat(x, counts) for x in (q, b0, b1, b2))
    c, length = letter[child], size[q]
    differs = lambda j: ((codes[np.minimum(at[q] + j, len(codes) - 1)] != c) | (length <= j)).astype(np.int8)
    n0 = np.minimum(b0 + differs(d - 1) if d else np.full(len(q), 2, np.int8), b1 + 1)
    n1 = np.where(length > d, np.minimum(np.minimum(b1 + differs(d), b2 + 1), n0 + 1), 2)
    n2 = np.where(length > d + 1, np.minimum(b2 + differs(d + 1), n1 + 1), 2)
    keep = np.minimum(np.minimum(n0, n1), n2) < 2
    q, child, length, n0, n1, n2 = (x[keep].astype(x.dtype) for x in (q, child, length, n0, n1, n2))
    ends = np.where(length == d, n0, np.where(length == d + 1, n1, np.where(length == d + 2, n2, 2))) == 1
    return (q, child, n0.astype(np.int8), n1.astype(np.int8), n2.astype(np.int8)), (q[ends], child[ends])


def _edges(words: list[str], n: np.ndarray, lists, m, s, e) -> pa.RecordBatch:
    q, other = near_in_lists(words, lists, m)
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    place = np.minimum(_common(codes, np.concatenate([[0], np.cumsum(size)[:-1]]), size, q, other), m[q] - 1)
    mine = (place >= s[q]) & (place < e[q])
    q, other = q[mine], other[mine]
    longer = size[other] > size[q]  # pairs of one length are found from both ends
    a, b = np.concatenate([q, other[longer]]), np.concatenate([other, q[longer]])
    held = pa.array(words, pa.string())
    return pa.RecordBatch.from_pydict({"word": held.take(pa.array(a)), "near": held.take(pa.array(b)), "near_n": n[b]})


def near_words(words: DataFrame, least_size: int = LEAST_SIZE, most: int = MOST) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart."""

    def run(batches):
        held = []

        def settle(last: bool):
            rows = pa.Table.from_batches(held)
            lists = rows.column("list").to_numpy()
            end = len(lists) if last else int(np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))[-1])
            held[:] = rows.slice(end).to_batches() if end < len(lists) else []
            if end:
                own = rows.slice(0, end)
                yield _edges(own.column("word").to_pylist(), *(own.column(c).to_numpy() for c in ("n", "list", "m", "s", "e")))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                yield from settle(False)
        if held:
            yield from settle(True)

    dealt = _dealt(words, least_size, most).repartition(F.col("list")).sortWithinPartitions("list", "word")
    return dealt.select("word", "n", "list", "m", "s", "e").mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead, for words with a form."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(up.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if not after.filter("moved").take(1):
            return now


def grouped(words: DataFrame, ratio: int = RATIO, least_size: int = LEAST_SIZE, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a vocabulary (word, n)."""
    words = written(words)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = near_words(words, least_size, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = -F.col("best.minus") >= ratio * F.col("n")
    formed = written(words.join(near.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.minus")).alias("form_n")))
    led = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(led.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", typo: int | None = TYPO, most: int = MOST) -> DataFrame:
    """The vocabulary of ``docs`` with forms and roots."""
    return grouped(vocabulary(docs, id_column, text_column, typo=typo), most=most)
