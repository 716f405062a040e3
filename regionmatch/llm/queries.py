"""One registered query for each operator, over its whole table, and the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionmatch.llm import labels as lab
from regionmatch.llm import license_scans as ls


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def op1_random_indexing_quality(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm import random_indexing as ri

    docs = _table(spark, sf, "documents")
    scored = ri.score(docs, *ri.fit(docs, _table(spark, sf, "labels")))
    return scored.select("doc_id", lab.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity_grammar(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm import toxicity_grammar as tg

    docs = _table(spark, sf, "documents")
    scored = tg.score(docs, tg.fit(docs, _table(spark, sf, "labels")))
    return scored.select("doc_id", lab.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         F.size("clauses").cast("long").alias("n_clauses"))


def op8_compression_bands(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm.compression_bands import compression_bands

    return compression_bands(_table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm import warc_chunks

    return warc_chunks.round_trip(_table(spark, sf, "pages"))


def op3_suffix_tree_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm.suffix_trees import dedup_words

    return dedup_words(_table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_bwt_merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm.bwt_merge import dedup_bytes

    return dedup_bytes(_table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_preference_format(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm import preference_format as pf

    return pf.preference_format(pf.pairs_of(_table(spark, sf, "conversations")))


def op7_piece_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Encode every whole text, decode it again, and carry the hash of what came back."""
    from regionmatch.llm import piece_lattice as pl

    vocabulary = pl.load()
    coded = pl.summary(pl.encode(_table(spark, sf, "documents"), vocabulary))
    back = pl.decode(coded, vocabulary)
    return back.select("doc_id", "n_pieces", "ids", "scores", "sizes", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_fm_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm import fm_decontamination as fm

    found = fm.find_contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), fm.contaminated().alias("contaminated"))


def op10_minhash_forest_join(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm.minhash_forest import jaccard_join

    return jaccard_join(_table(spark, sf, "documents"))


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm.spelling_variants import spelling_variants

    return spelling_variants(_table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_license_set_join(spark: SparkSession, sf: str) -> DataFrame:
    return ls.license_scan(_table(spark, sf, "documents"))


def op13_aho_corasick_search(spark: SparkSession, sf: str) -> DataFrame:
    from regionmatch.llm.ranked_search import ranked_search

    return ranked_search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_random_indexing_quality, op2_warc_chunks, op3_suffix_tree_dedup, op4_toxicity_grammar, op5_bwt_merge_dedup, op6_preference_format,
    op7_piece_lattice, op8_compression_bands, op9_fm_decontamination, op10_minhash_forest_join, op11_spelling_variants, op12_license_set_join,
    op13_aho_corasick_search,
)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OTHER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _license_sql() -> str:
    """Places of phrases by comparing slices, containment by intersecting every block with every template."""
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    phrases = ", ".join(f"('{label}', {quoted(ls.tokens(phrase))})" for phrase, label in ls.PHRASES)
    sets = [(label, sorted(set(ls.tokens(text)))) for label, text in ls.TEMPLATES]
    templates = ", ".join(f"('{label}', {len(own)}, {ls.least_overlap(len(own), ls.THRESHOLD)}, {quoted(own)})" for label, own in sets)
    span = max(len(ls.tokens(text)) for _, text in ls.TEMPLATES)
    return f"""
WITH w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_OTHER}') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)),
p(label, own) AS (VALUES {phrases}),
place AS (SELECT r, i - 1 AS pos, label FROM (SELECT r, w, label, own, unnest(generate_series(1, len(w) - len(own) + 1)) AS i FROM w, p WHERE list_has_all(w, own)) WHERE w[i:i + len(own) - 1] = own),
base AS (SELECT r, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM place GROUP BY 1),
tpl(label, n, need, own) AS (VALUES {templates}),
line AS (SELECT r, regexp_extract_all(unnest(string_split(t, chr(10))), '{_OTHER}') AS x FROM w),
block AS (SELECT r, x[s + 1:s + {2 * span}] AS x FROM (SELECT r, x, unnest(generate_series(0, greatest(len(x) - {span} - 1, 0), {span})) AS s FROM line WHERE len(x) > 0)),
hit AS (SELECT r, label, len(list_intersect(own, x)) / n AS part FROM block, tpl WHERE len(list_intersect(own, x)) >= need),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT r, label FROM hit UNION ALL SELECT r, label FROM place) GROUP BY 1),
best AS (SELECT r, max(part) AS part FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  coalesce(base.l, '') AS base_labels, coalesce(named.l, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLE: dict[str, str] = {
    "op2_warc_chunks": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN k.keeper IS NULL OR k.keeper = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.h = k.h""",
    "op3_suffix_tree_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_preference_format": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
n AS (SELECT conv_id, count(*) AS n, max(i) FILTER (role = 'assistant') AS last, min(i) FILTER (role = 'assistant') AS first FROM c GROUP BY 1),
o AS (SELECT conv_id, role AS r0, text AS t0 FROM c WHERE i = 1),
l AS (SELECT r0, t0, min(conv_id) AS leader FROM o GROUP BY 1, 2 HAVING count(*) > 1),
p AS (SELECT o.conv_id AS pair_id, CASE WHEN l.leader <> o.conv_id THEN l.leader ELSE o.conv_id END AS chosen_id, coalesce(l.leader <> o.conv_id, false) AS led
  FROM o LEFT JOIN l USING (r0, t0)),
side AS (
  SELECT pair_id, 'c' AS s, i, role, text FROM p JOIN c ON c.conv_id = p.chosen_id
  UNION ALL SELECT pair_id, 'r', i, role, text FROM p JOIN c ON c.conv_id = p.pair_id WHERE led
  UNION ALL SELECT pair_id, 'r', c.i, c.role, CASE WHEN c.i = n.last THEN coalesce(f.text, '') ELSE c.text END
  FROM p JOIN c ON c.conv_id = p.pair_id JOIN n ON n.conv_id = p.pair_id
  LEFT JOIN c f ON f.conv_id = p.pair_id AND f.i = CASE WHEN n.first < n.last THEN n.first ELSE n.last - 1 END
  WHERE NOT led AND c.i <= coalesce(n.last, n.n - 1)),
m AS (SELECT p.pair_id, coalesce(min(CASE WHEN b.i IS NULL OR a.role <> b.role OR a.text <> b.text THEN a.i END) - 1, max(a.i)) AS k
  FROM p JOIN side a ON a.pair_id = p.pair_id AND a.s = 'c' LEFT JOIN side b ON b.pair_id = p.pair_id AND b.s = 'r' AND b.i = a.i GROUP BY 1),
x AS (SELECT side.pair_id, s, i, role, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS t, length(role) + 5 AS h,
  sum(CASE WHEN i > k THEN length(role) + length(text) + 13 END) OVER (PARTITION BY side.pair_id, s ORDER BY i) AS e, length(role) + length(text) + 13 AS z FROM side JOIN m USING (pair_id)),
g AS (SELECT pair_id,
  string_agg(t, '' ORDER BY i) FILTER (s = 'c' AND i <= k) AS prompt, string_agg(t, '' ORDER BY i) FILTER (s = 'c' AND i > k) AS chosen_text,
  string_agg(t, '' ORDER BY i) FILTER (s = 'r' AND i > k) AS rejected_text,
  string_agg(CAST(e - z + h AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY i) FILTER (s = 'c' AND i > k AND role = 'assistant') AS chosen_mask,
  string_agg(CAST(e - z + h AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY i) FILTER (s = 'r' AND i > k AND role = 'assistant') AS rejected_mask
  FROM x GROUP BY 1)
SELECT p.pair_id, p.chosen_id, CAST(m.k AS INTEGER) AS n_common, coalesce(prompt, '') AS prompt, coalesce(chosen_text, '') AS chosen_text,
  coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected_text, '') AS rejected_text, coalesce(rejected_mask, '') AS rejected_mask
FROM p JOIN m USING (pair_id) JOIN g USING (pair_id)""",
    "op9_fm_decontamination": f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, k)),
hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_bwt_merge_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT doc_id, c, h[1024 * c + 1:1024 * c + 1122] AS x FROM (SELECT doc_id, h, unnest(generate_series(0, (length(h) // 2 - 50) // 512)) AS c FROM d WHERE length(h) >= 100)),
win AS (SELECT doc_id, 512 * c + j AS i, x[2 * j + 1:2 * j + 100] AS k FROM (SELECT doc_id, c, x, unnest(generate_series(0, least(511, length(x) // 2 - 50))) AS j FROM piece)),
low AS (SELECT k, min(doc_id) AS low FROM win GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
rep AS (SELECT doc_id, i FROM win JOIN low USING (k) WHERE doc_id > low),
edge AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 50 AS fresh FROM (SELECT DISTINCT doc_id, i FROM rep)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge) GROUP BY doc_id, r),
gap AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM run),
kept AS (SELECT doc_id, string_agg(h[2 * p + 1:2 * a], '' ORDER BY a) || any_value(h)[2 * max(e) + 1:] AS t, sum(e - a) AS n, count(*) AS s FROM gap JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_spelling_variants": f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
own AS (SELECT doc_id, w, count(*) AS c FROM run GROUP BY 1, 2),
bytes AS (SELECT w, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
  lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)) AS b FROM own),
crc AS (SELECT w, c, xor(list_reduce(b, lambda h, x: xor(t[xor(h, x) % 256 + 1], h >> 8), 4294967295), 4294967295) AS h FROM bytes, tab),
word AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, c FROM crc),
v AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM word WHERE length(w) >= 5 GROUP BY 1 HAVING sum(c) >= 3),
del AS (SELECT w, n, i, w[1:i - 1] || '*' || w[i + 1:] AS holed, w[1:i - 1] || w[i + 1:] AS short FROM (SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM v)),
pair AS (SELECT a.w, b.w AS o, b.n FROM del a JOIN del b ON a.i = b.i AND a.holed = b.holed AND a.w <> b.w
  UNION SELECT v.w, d.w, d.n FROM v JOIN del d ON v.w = d.short UNION SELECT d.w, v.w, v.n FROM v JOIN del d ON v.w = d.short),
near AS (SELECT w, count(*) AS m, min((-n, o)) AS best FROM pair GROUP BY 1),
f AS (SELECT v.w, v.n, coalesce(m, 0) AS m, CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN near USING (w)),
up AS (SELECT w, w AS root FROM f WHERE form IS NULL UNION ALL SELECT f.w, up.root FROM f JOIN up ON f.form = up.w)
SELECT w AS word, form, root, n, CAST(m AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN up USING (w)""",
    "op12_license_set_join": _license_sql(),
    "op13_aho_corasick_search": rf"""
WITH term AS (SELECT r, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS w
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
tf AS (SELECT r, doc_id, w, count(*) AS tf FROM term GROUP BY 1, 2, 3),
len AS (SELECT r, count(*) AS n FROM term GROUP BY 1),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
item AS (SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
need AS (SELECT item_id, w, count(*) AS times FROM item GROUP BY 1, 2),
part AS (SELECT item_id, r, doc_id, times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS s
  FROM need JOIN tf USING (w) JOIN df USING (w) JOIN len USING (r), tot),
score AS (SELECT item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM part GROUP BY 1, 2, 3 HAVING sum(s) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score) WHERE rank <= 10""",
}
