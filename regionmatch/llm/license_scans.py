"""License scan by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

1. Texts are lower-cased (A to Z) and split to words once. Places of the base phrases are found in the words of
   texts that hold all words of a phrase.
2. ``token_order``: every token of a template is counted over all documents; templates and blocks are lists of
   tokens, rarest first. Tokens of no template can add nothing to an overlap and are left out of blocks.
3. A text whose words reach no template's least overlap has no block. Others are split to lines, and lines to
   blocks of 2S words at every S-th word, S being the longest template's words, so a template that stands whole
   in a line stands whole in a block.
4. ``contained`` joins blocks with templates on tokens of both prefixes. With least overlap a = ceil(threshold * |T|),
   the first |T| - a + 1 tokens of a template and the first |B| - a + 1 of a block share one if they overlap by a
   (prefix filter); |B| >= a (length filter); and from the first shared token on enough tokens must be left on
   both sides (positional filter). Survivors are verified on their whole lists.

So every block that holds at least ``threshold`` of a template's different words is found, and no other.

Result, one row per row: the id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest
part of a template that a block holds; 1 where a base phrase stands).

Cases: null and empty texts have no words and no labels; repeated rows give equal rows; a null id is kept; ties do
not arise. A text of any length is split to blocks of bounded size. Other columns are ignored; an empty table gives
no rows. Templates and phrases are parameters; their tokens are literals of the plan and bounded by MOST_TOKENS.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionmatch.llm.staging import written

#: Phrases and labels of the base rule.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices as their publishers word them.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
THRESHOLD = 0.9
MOST_TOKENS = 10_000
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str) -> list[str]:
    """Words of a template, as ``words_of`` finds them in a column."""
    return [w for w in re.split(OTHER, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def least_overlap(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def words_of(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, OTHER), "")


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _lowered(docs: DataFrame, text_column: str) -> Column:
    return F.translate(F.coalesce(docs[text_column], F.lit("")), _UPPER, _LOWER)


def token_order(docs: DataFrame, text_column: str, templates) -> list[str]:
    """All tokens of the templates, those of the fewest documents first."""
    every = sorted({w for _, text in templates for w in tokens(text)})
    if len(every) > MOST_TOKENS:
        raise ValueError(f"templates have {len(every)} different words; the bound is {MOST_TOKENS}")
    held = docs.select(F.explode(F.array_intersect(words_of(_lowered(docs, text_column)), _list(every))).alias("token"))
    count = {r[0]: r[1] for r in held.groupBy("token").agg(F.count("*")).collect()}
    return sorted(every, key=lambda w: (count.get(w, 0), w))


def _template_rows(templates, order: list[str], threshold: float) -> list[tuple[str, int, int, list[str]]]:
    """(label, size, least overlap, tokens in order) of every template that has a token."""
    rank = {w: i for i, w in enumerate(order)}
    rows = [(label, sorted(set(tokens(text)), key=rank.__getitem__)) for label, text in templates]
    return [(label, len(own), least_overlap(len(own), threshold), own) for label, own in rows if own]


def _blocks(lowered: Column, span: int, order: list[str]) -> Column:
    """Token lists, rarest first, of all blocks of a text."""

    def pieces(line: Column) -> Column:
        words = words_of(line)
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - span - 1, F.lit(0)), F.lit(span))
        return F.transform(starts, lambda s: F.slice(words, s + 1, 2 * span))

    return F.transform(F.flatten(F.transform(F.split(lowered, "\n"), pieces)), lambda block: F.array_intersect(_list(order), block))


def contained(blocks: DataFrame, templates, order: list[str], threshold: float) -> DataFrame:
    """``blocks`` (with ``tokens`` in order) and label, part of each template they contain to the threshold."""
    rows = _template_rows(templates, order, threshold)
    made = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(n).alias("n"), F.lit(a).alias("a"), _list(own).alias("own"))
                     for i, (label, n, a, own) in enumerate(rows)])
    table = blocks.sparkSession.range(1).select(F.inline(made))
    index = table.select("template", "label", "n", "a", "own", F.posexplode(F.slice("own", F.lit(1), F.col("n") - F.col("a") + 1)).alias("i", "token"))
    least = min(a for _, _, a, _ in rows)
    size = F.size("tokens")
    probes = blocks.filter(size >= least).withColumn("size", size)
    probes = probes.select("*", F.posexplode(F.slice("tokens", F.lit(1), size - least + 1)).alias("j", "token"))
    met = probes.join(F.broadcast(index), "token").filter(
        (F.col("size") >= F.col("a")) & (F.col("j") <= F.col("size") - F.col("a")) & (F.least(F.col("n") - F.col("i"), F.col("size") - F.col("j")) >= F.col("a")))
    shared = F.size(F.array_intersect("own", "tokens"))
    return met.withColumn("shared", shared).filter("shared >= a").select(*blocks.columns, "label", (F.col("shared") / F.col("n")).alias("part"))


def _places_of(words: Column, phrase: list[str], label: str) -> Column:
    """(label, first word) of every place of one phrase; only texts that hold all of its words are searched."""
    first = F.sequence(F.lit(0), F.size(words) - len(phrase))
    stands = lambda i: reduce(and_, [F.get(words, i + k) == w for k, w in enumerate(phrase)])
    held = (F.size(F.array_intersect(_list(phrase), words)) == len(set(phrase))) & (F.size(words) >= len(phrase))
    spots = F.transform(F.filter(first, stands), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))
    return F.when(held, spots).otherwise(F.array().cast("array<struct<label:string,at:bigint>>"))


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    order = token_order(docs, text_column, templates)
    rows = _template_rows(templates, order, threshold)
    span = max(len(tokens(text)) for _, text in templates)
    text = F.coalesce(docs[text_column], F.lit(""))
    base = docs.select(docs[id_column].alias("doc_id"), F.struct(F.xxhash64(text), F.crc32(text), F.octet_length(text)).alias("body"), _lowered(docs, text_column).alias("lowered"))
    base = base.withColumn("words", words_of(F.col("lowered")))
    own = F.array_intersect(_list(order), F.col("words"))
    reached = F.lit(False)
    for _, _, a, tokens_of in rows:
        reached = reached | (F.size(F.array_intersect(_list(tokens_of), F.col("own"))) >= a)
    base = base.withColumn("own", own).withColumn("blocks", F.when(reached, _blocks(F.col("lowered"), span, order)))
    main = written(base.select("doc_id", "body", F.size("words").cast("long").alias("n_words"), F.concat(*[_places_of(F.col("words"), tokens(phrase), label) for phrase, label in phrases]).alias("places"), "blocks"))
    blocks = main.select("doc_id", "body", F.explode("blocks").alias("tokens"))
    found = contained(blocks, templates, order, threshold).groupBy("doc_id", "body").agg(F.collect_set("label").alias("found"), F.max("part").alias("part"))
    found = found.select(F.col("doc_id").alias("in_doc"), F.col("body").alias("in_body"), "found", "part").hint("merge")
    both = main.join(found, main["doc_id"].eqNullSafe(found["in_doc"]) & (main["body"] == found["in_body"]), "left")
    labels = F.transform("places", lambda p: p["label"])
    at = F.transform("places", lambda p: p["at"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return both.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined(labels).alias("base_labels"), joined(F.concat(labels, F.coalesce("found", none))).alias("labels"),
        F.greatest(F.coalesce("part", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"))
