"""License notices: exact phrases, and an exact set-similarity join of text blocks with notice templates.

A template is found in a block if the block holds at least ``threshold`` of the template's distinct words
(containment). The join is exact and never looks at all pairs:

* words of templates are ordered by how many blocks hold them, rarest first, counted over all blocks;
* prefix filter: a block and a template with the needed overlap share a word in the first ``size - needed + 1`` words
  of either one;
* length filter: the block holds at least ``needed`` template words;
* positional filter: what follows the shared word in either set must suffice for the needed overlap.

A pair is verified once, at its first common word. Words that no template holds can't add to an overlap, so blocks
are reduced to template words in the one pass over the texts. Everything is built-in DataFrame functions.

Blocks are paragraphs: they end at lines without a word, as blank ones or those of a comment's frame are, so notices
that are wrapped over several lines are whole in one block (``block`` takes another separator). Templates are a parameter: sentences
that open a notice, as they are here, or whole paragraphs. NULL text is the empty text: no words,
no labels, score 0. Rows with equal ids are handled on their own. An empty table, or no templates, gives no labels.
Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: What stands between paragraphs: the end of a line, and lines that hold no word.
PARAGRAPH = r"\n(?:[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n)+"

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening sentences of public licenses, and the usual one-line notices.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Share of a template's distinct words that a block has to hold.
THRESHOLD = 0.9


def lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay, as their lower case may be an ASCII letter."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def python_words(text: str) -> list[str]:
    """The same words of a template."""
    spaced = "".join(c.lower() if c in UPPER else c if ord(c) > 127 or c in LOWER + "0123456789" else " " for c in text)
    return spaced.split(" ")


def template_sets(templates: Sequence[tuple[str, str]], threshold: float) -> list[tuple[str, frozenset[str], int]]:
    """Label, distinct words and needed overlap of each template that has words."""
    sets = [(label, frozenset(python_words(text)) - {""}) for label, text in templates]
    return [(label, s, max(1, math.ceil(threshold * len(s) - 1e-9))) for label, s in sets if s]


def _places(phrases: Sequence[tuple[str, str]]) -> Column:
    """Where the words of a phrase stand one after the other: ``array<struct<start, label>>``."""
    return F.concat(*[_places_of(python_words(phrase), label) for phrase, label in phrases])


def _places_of(parts: list[str], label: str) -> Column:
    def here(i):
        return reduce(and_, [F.get("words", i + k) == part for k, part in enumerate(parts)])

    maybe = reduce(and_, [F.col("lowered").contains(part) for part in sorted(set(parts))])
    starts = F.filter(F.sequence(F.lit(0), F.size("words")), here)
    one = F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
    return F.when(maybe, one).otherwise(F.expr("CAST(array() AS array<struct<start:bigint,label:string>>)"))


def prepared(docs: DataFrame, vocabulary: Sequence[str], phrases, id_col: str, text_col: str, block: str) -> DataFrame:
    """The one pass over the texts: ``row, doc_id, n_words, places, blocks`` (the template words of each block)."""
    texts = common.text_of(docs, id_col, text_col)
    rows = texts.select("doc_id", lower(F.col("text")).alias("lowered"))
    rows = rows.withColumn("words", words(F.col("lowered")))
    known = list(vocabulary) or [""]
    hits = F.transform(
        F.split("lowered", block),
        lambda b: F.array_distinct(F.filter(F.split(b, GAP), lambda w: (w != "") & w.isin(*known))),
    )
    return rows.select(
        common.row_key().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _places(phrases).alias("places"),
        F.filter(hits, lambda b: F.size(b) > 0).alias("blocks"),
    )


def block_matches(rows: DataFrame, sets: Sequence[tuple[str, frozenset[str], int]]) -> DataFrame:
    """``row, label, containment`` of every block and template that meet the threshold.

    The templates are a parameter and small; so are the counts of their words, one row per distinct template word.
    """
    spark = rows.sparkSession
    each = rows.select(F.explode("blocks").alias("block")).select(F.explode("block").alias("word"))
    counts = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    vocabulary = sorted(set().union(*(s for _, s, _ in sets)), key=lambda w: (counts.get(w, 0), w))
    rank = {w: k + 1 for k, w in enumerate(vocabulary)}
    ordered = [(label, sorted(rank[w] for w in s), needed) for label, s, needed in sets]
    prefixes = spark.createDataFrame(
        [
            (token, i, label, tokens, needed)
            for label, tokens, needed in ordered
            for i, token in enumerate(tokens[: len(tokens) - needed + 1])
        ],
        "token int, i int, label string, tokens array<int>, needed int",
    )
    least = min(needed for _, _, needed in ordered)
    order = F.array(*[F.lit(w) for w in vocabulary])
    blocks = (
        rows.select("row", F.explode("blocks").alias("block"))
        .where(F.size("block") >= least)
        .select("row", F.array_sort(F.transform("block", lambda w: F.array_position(order, w).cast("int"))).alias("block"))
    )
    first = F.slice("block", F.lit(1), F.size("block") - least + 1)
    pairs = blocks.select("row", "block", F.posexplode(first).alias("j", "token")).join(F.broadcast(prefixes), "token")
    size, length = F.size("tokens"), F.size("block")
    pairs = pairs.where(
        (length >= F.col("needed"))
        & (F.col("j") <= length - F.col("needed"))
        & (1 + F.least(size - F.col("i") - 1, length - F.col("j") - 1) >= F.col("needed"))
    )
    common_words = F.array_intersect("tokens", "block")
    return (
        pairs.withColumn("both", common_words)
        .where((F.array_min("both") == F.col("token")) & (F.size("both") >= F.col("needed")))
        .select("row", "label", (F.size("both") / size).alias("containment"))
    )


def license_scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: str = PARAGRAPH,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of all phrases, ``first_word`` and ``last_word`` are their smallest and largest start.
    ``labels`` adds those of the templates found; ``score`` is 1 for a phrase, else the best containment found, else 0.
    """
    sets = template_sets(templates, threshold)
    vocabulary = sorted(set().union(*(s for _, s, _ in sets))) if sets else []
    rows = common.stage(prepared(docs, vocabulary, phrases, id_col, text_col, block), "license-blocks")
    if sets:
        found = block_matches(rows, sets).groupBy("row").agg(
            F.collect_set("label").alias("more"), F.max("containment").alias("best")
        )
    else:
        found = rows.limit(0).select("row", F.array(F.lit("")).alias("more"), F.lit(0.0).alias("best"))
    starts = F.transform("places", lambda p: p["start"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    none = F.expr("CAST(array() AS array<string>)")
    return rows.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def oracle_sql(templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, block: str = PARAGRAPH) -> str:
    """The same by brute force over all blocks and templates."""

    def quoted(items):
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"

    places = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM positions WHERE "
        + " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(python_words(phrase)))
        for phrase, label in phrases
    )
    rows = ", ".join(f"('{label}', {quoted(sorted(s))}, {n})" for label, s, n in template_sets(templates, threshold))
    return f"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), worded AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '{GAP}'), lambda x: x <> '') AS w FROM lowered
), positions AS (SELECT r, w, unnest(range(len(w))) AS i FROM worded),
places AS ({places}),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base
  FROM places GROUP BY r
), blocks AS (
  SELECT r, string_split_regex(b, '{GAP}') AS b FROM (SELECT r, unnest(string_split_regex(t, '{block}')) AS b FROM worded)
), found AS (
  SELECT r, list(DISTINCT label) AS more, max(len(list_intersect(s, b)) / CAST(len(s) AS DOUBLE)) AS best
  FROM blocks, (VALUES {rows}) AS templates(label, s, needed)
  WHERE len(list_intersect(s, b)) >= needed GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM worded LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""
