"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are windows over a text's words, twice as long as the templates that they meet and half overlapping, so every
stretch as long as a template lies whole in a block. A block has a template where it holds 90% of its distinct words. Template words
are ordered by their counts in the whole corpus, rarest first. Only rare prefixes of the templates are joined with
the words of the texts; the length of a block's share of template words and the positions of the first common word
then leave few pairs, whose overlap is counted.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Public license notices and the labels that they stand for.
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER, OTHER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Share of a template's distinct words that a block must hold, in percent.
PERCENT = 90


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(f"{LETTER}+"), F.lit(0))


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def half_block(n: int) -> int:
    """Words of half a block for templates of n words: the next power of two."""
    return 1 << max(0, n - 1).bit_length()


def _standing(phrases: list[str]) -> str:
    return rf"(?<!{LETTER})(?:{'|'.join(f'{OTHER}+'.join(p.split()) for p in phrases)})(?!{LETTER})"


def base_hits(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, n_words, n_base, first_word, last_word, base: the base phrases of every text, and its hash."""
    low, anywhere = F.col("low"), _standing([p for p, _ in PHRASES])
    # no phrase ends in the word that another starts with, so hits never overlap
    rows = docs.select("doc_id", folded(F.col("text")).alias("low"))
    rows = rows.withColumn("n_base", F.when(reduce(or_, [low.contains(p.split()[-1]) & low.contains(p.split()[0]) for p, _ in PHRASES]), F.regexp_count(low, F.lit(anywhere))).otherwise(0).cast("long"))
    before = lambda span: F.when(F.col("n_base") > 0, F.regexp_count(F.regexp_extract(low, f"(?s)^({span}){anywhere}", 1), F.lit(f"{LETTER}+")).cast("long"))
    label = lambda p, x: F.when((F.col("n_base") > 0) & low.rlike(_standing([p])), F.lit(x))
    base = F.array_compact(F.array(*[label(p, x) for p, x in PHRASES]))
    return rows.select("doc_id", *_key(low), F.regexp_count(low, F.lit(f"{LETTER}+")).cast("long").alias("n_words"), "n_base", before(".*?").alias("first_word"), before(".*").alias("last_word"), base.alias("base"))


def _key(low: Column) -> list[Column]:
    return [F.xxhash64(low).alias("h1"), F.xxhash64(F.lit("l"), low).alias("h2")]


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words by their counts in all texts, rarest first; at most as many rows as there are template words are collected."""
    token = docs.select(F.explode_outer(words(folded(F.col("text")))).alias("token")).filter(F.col("token").isin(vocabulary))
    counts = {r["token"]: r["count"] for r in token.groupBy("token").count().collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def matched(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """h1, h2, start, label, template, containment: every block that holds ``percent`` of a template's distinct words or more.

    h1 and h2 hash the lower-case text, and start is the block's first word. Rows with equal text give equal rows here.
    """
    spark = docs.sparkSession
    sets = [(label, template_words(text)) for label, text in templates]
    order = global_order(docs, sorted({w for _, ws in sets for w in ws}))
    rank = {w: i for i, w in enumerate(order)}
    entries = []
    for number, (label, ws) in enumerate(sets):
        own = sorted(set(ws), key=rank.__getitem__)
        need = -(-percent * len(own) // 100)
        entries += [(w, number, label, own, i, need, half_block(len(ws))) for i, w in enumerate(own[: len(own) - need + 1])]
    index = spark.createDataFrame(entries, "token string, template int, label string, own array<string>, i int, need int, half int")
    # bounded by the templates, which are a parameter
    low = folded(F.col("text"))
    rows = docs.select(*_key(low), words(low).alias("words"))
    # the outer form, as the other would extract the words once more to test that there are any
    met = rows.select("h1", "h2", "words", F.posexplode_outer("words").alias("pos", "token")).join(F.broadcast(index), "token")
    block = F.floor(F.col("pos") / F.col("half")).cast("int")
    met = met.select("*", F.explode(F.array(block, block - 1)).alias("block")).filter("block >= 0")
    share = F.array_intersect(F.array(*map(F.lit, order)), F.slice("words", F.col("block") * F.col("half") + 1, 2 * F.col("half")))
    met = met.select("h1", "h2", (F.col("block") * F.col("half")).alias("start"), "template", "label", "token", "own", "i", "need", share.alias("share"))
    held = F.size("share")
    j = F.array_position("share", F.col("token")) - 1
    # if this is the first word that both have, what follows it in either bounds the overlap
    near = (held >= F.col("need")) & (1 + F.least(F.size("own") - F.col("i") - 1, held - j - 1) >= F.col("need"))
    overlap = F.size(F.array_intersect("own", "share"))
    found = met.filter(near).withColumn("overlap", overlap).filter(F.col("overlap") >= F.col("need"))
    return found.select("h1", "h2", "start", "label", "template", (F.col("overlap") / F.size("own")).alias("containment")).distinct()


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Labels are of the base phrases and of the templates that a block of the text holds; score is 1 with a base phrase,
    else the greatest containment that met the threshold, else 0. Null and empty texts have no words and no labels; texts of any length are
    scanned whole, block by block; repeated rows are rows of their own with equal results, and null ids stay; ties need no
    order, as labels are sorted. An empty table gives an empty result; other columns are ignored.
    """
    found = matched(docs, templates, percent).groupBy("h1", "h2").agg(F.collect_set("label").alias("added"), F.max("containment").alias("containment"))
    rows = base_hits(docs).join(found, ["h1", "h2"], "left")
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    added = F.coalesce("added", F.array().cast("array<string>"))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"), listed(F.concat("base", added)).alias("labels"), score.alias("score"))


def _scan_sql() -> str:
    one = ", ".join(f"({i}, '{label}', {template_words(text)!r}, {half_block(len(template_words(text)))})" for i, (label, text) in enumerate(TEMPLATES))
    hits = " UNION ALL ".join(
        f"SELECT row, i, '{label}' AS label FROM places WHERE " + " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(p.split(), 1)) for p, label in PHRASES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
places AS (SELECT row, words, unnest(range(0, len(words))) AS i FROM d),
hits AS ({hits}),
base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY row),
t(template, label, ws, half) AS (VALUES {one}),
halves AS (SELECT DISTINCT half FROM t),
blocks AS (SELECT row, half, list_distinct(words[b * half + 1:(b + 2) * half]) AS block FROM (SELECT row, words, half, unnest(range(0, len(words) // half + 1)) AS b FROM d, halves)),
own AS (SELECT template, label, half, list_distinct(ws) AS own FROM t),
met AS (SELECT row, label, len(list_intersect(own, block)) AS overlap, len(own) AS size FROM blocks JOIN own USING (half)),
found AS (SELECT row, list(DISTINCT label) AS added, max(overlap / size::DOUBLE) AS containment FROM met WHERE overlap >= ceil({PERCENT} * size / 100.0) GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(added, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""


SCAN_SQL = _scan_sql()
