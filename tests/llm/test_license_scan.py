import re

import duckdb

from evenkeel.llm import license_scan as L


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(L.UPPER, L.LOWER))) if w]


def paragraphs(text):
    """Lines in groups, which end at lines without a word."""
    group = []
    for line in text.split("\n"):
        if words(line):
            group.append(line)
        else:
            yield "\n".join(group)
            group = []
    yield "\n".join(group)


def brute(rows, templates=L.TEMPLATES, phrases=L.PHRASES, threshold=L.THRESHOLD):
    out = []
    for i, text in rows:
        text = text or ""
        w, places = words(text), []
        for phrase, label in phrases:
            p = phrase.split(" ")
            places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        found = []
        for block in paragraphs(text):
            for label, template in templates:
                t = set(words(template))
                share = len(t & set(words(block))) / len(t)
                if share >= threshold - 1e-12:
                    found.append((share, label))
        starts, base = [k for k, _ in places], {x for _, x in places}
        score = 1.0 if places else max((s for s, _ in found), default=0.0)
        out.append((
            i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {x for _, x in found})), score,
        ))
    return sorted(out, key=repr)


ROWS = [
    (1, None), (2, ""), (3, "Released under the MIT License."), (4, "mit\nlicense MIT-LICENSE; mitlicense"),
    (5, "Licensed under CC BY-NC 4.0."), (6, "Licensed under CC BY 4.0"), (7, "K MIT License é"),
    (8, "x " * 20_000 + "general public license apache license"), (None, "This work is licensed under the GNU General Public License, version 3."),
    (9, "licensed the you may not use this file except compliance with License apache version 2 0 in under"),
    (9, "licensed the you may not use this file except compliance with License apache version 2 0 in under"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and documentation"),
    (11, "\n\n of the and or is to a"), (12, "general public general public license license mit license mit license"),
]


# The usual notices, wrapped and framed as they stand in source files.
MIT = """/*
 * Copyright (c) 2020 Somebody
 *
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
 */
int main() { return 0; }
"""
BSD = """# Copyright 2019 Somebody. All rights reserved.
#
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:
#
#    * Redistributions of source code must retain the above notice.
import os
"""
ISC = """-- Permission to use, copy, modify, and/or distribute this software for any
-- purpose with or without fee is hereby granted, provided that the above
-- copyright notice and this permission notice appear in all copies.

local x = 1
"""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
"""


def test_wrapped_notices_are_found(spark):
    torn = "\n\n".join(ISC.split("\n"))  # a paragraph for each line
    rows = [(1, MIT), (2, BSD), (3, ISC), (4, APACHE), (5, torn), (6, MIT.replace("\n", "\r\n"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in L.license_scan(docs).collect()}
    assert {i: r.labels for i, r in found.items()} == {1: "mit", 2: "bsd", 3: "isc", 4: "apache", 5: "", 6: "mit"}
    assert [found[i].base_labels for i in (1, 2, 3, 4)] == ["", "", "", "apache"]
    assert got(L.license_scan(docs)) == brute(rows)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(db.sql(L.oracle_sql()).fetchall(), key=repr) == brute(rows)


def test_very_long_texts(spark):
    text = "the quick mit " * 100_000 + "license\n" * 200_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = L.license_scan(docs).first()
    assert (row.n_words, row.n_base, row.first_word, row.labels) == (500_000, 1, 299_999, "mit")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, row int, words string")
    for threshold in (0.9, 0.5, 0.2, 1.0):
        assert got(L.license_scan(docs, threshold=threshold)) == brute(ROWS, threshold=threshold)


def test_other_templates_and_none(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    some = (("a", "of the and"), ("b", "the the a"), ("none", "..."))
    assert got(L.license_scan(docs, templates=some, threshold=0.7)) == brute(ROWS, some[:2], threshold=0.7)
    assert got(L.license_scan(docs, templates=())) == brute(ROWS, ())


def test_empty(spark):
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
