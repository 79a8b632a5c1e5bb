"""License notices in documents, by Dice coefficient over word bigrams.

A unit is a line of a document, or all of it.  Its normalised words' bigrams,
repeats included, are compared with those of each template; sizes bound the
coefficient from above, so only templates of a fitting size that share a
bigram are compared at all.  Everything is DataFrame expressions on one row,
without a join or a shuffle up to the last count.

Nulls: a null text has no units; a null id is reported like any other.  Rows
that repeat an id are counted together.  Texts of any length are compared unit
by unit.  Equal coefficients go to the first license by name.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The usual short notices of common licenses.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

NOT_WORD, LAST_DOT = "[^a-z0-9.\\n]+", "\\.+( |\\n|$)"


def normalise(text: str) -> str:
    import re

    s = re.sub(LAST_DOT, r" \1", re.sub(NOT_WORD, " ", text.lower()))
    return " ".join(s.split())


def bigrams(text: str) -> list[str]:
    w = normalise(text).split(" ")
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def bounds(size: int, least: float) -> tuple[int, int]:
    """Sizes whose Dice coefficient with ``size`` bigrams can reach ``least``: 2 min / (a + b) is at least that."""
    lo = next(n for n in range(1, size + 1) if 2 * n >= least * (n + size))
    hi = size
    while 2 * size >= least * (hi + 1 + size):
        hi += 1
    return lo, hi


def _templates(templates: list[tuple[str, str]], least: float) -> Column:
    rows = []
    for name, text in templates:
        b = bigrams(text)
        lo, hi = bounds(len(b), least)
        distinct = sorted(set(b))
        rows.append(F.struct(
            F.lit(name).alias("license"), F.lit(len(b)).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
            F.array(*[F.lit(x) for x in distinct]).alias("b"), F.array(*[F.lit(b.count(x)) for x in distinct]).alias("times"),
        ))
    return F.array(*rows)


def scan(docs: DataFrame, least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, n_units (units whose best license it is) and dice (the largest, 6 places)."""
    sizes = [bounds(len(bigrams(t)), least) for _, t in templates]
    lo, hi = min(a for a, _ in sizes), max(b for _, b in sizes)
    spaced = F.regexp_replace(F.lower("text"), NOT_WORD, " ")
    tidy = F.regexp_replace(F.regexp_replace(spaced, LAST_DOT, " $1"), "  +", " ")
    lines = F.transform(F.split("tidy", "\n"), lambda u: F.trim(u))
    whole = F.trim(F.regexp_replace("tidy", "[ \n]+", " "))

    def size(unit: Column) -> Column:  # bigrams, as words are one blank apart
        return F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit("")))

    several = F.instr(F.col("tidy"), "\n") > 0
    units = F.concat(lines, F.when(several, F.array(whole)).otherwise(F.array().cast("array<string>")))
    fitting = F.filter(units, lambda u: size(u).between(lo, hi))
    # what several expressions use goes through explode, so that it is worked out once a row
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    each = docs.select("doc_id", once(F.coalesce(tidy, F.lit("")), "tidy")).select("doc_id", F.explode(fitting).alias("unit"))
    each = each.select("doc_id", once(F.split("unit", " "), "w"))
    pair = F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda x, y: F.concat(x, F.lit(" "), y))
    each = each.select("doc_id", once(pair, "b"))
    known = _templates(templates, least)
    like = F.filter(known, lambda t: F.size("b").between(t["lo"], t["hi"]) & F.arrays_overlap("b", t["b"]))

    def dice(t: Column) -> Column:
        each_shared = F.zip_with(t["b"], t["times"], lambda x, k: F.least(k, F.size(F.filter("b", lambda y: y == x))))
        shared = F.aggregate(each_shared, F.lit(0), lambda a, x: a + x)
        return F.round(2.0 * shared / (F.size("b") + t["n"]), 6)

    # the first by name among the largest: templates are in order of their names
    pairs = each.select("doc_id", "b", once(like, "like")).where(F.size("like") > 0)
    scores = F.transform("like", lambda t: F.struct(dice(t).alias("dice"), t["license"].alias("license")))
    scored = pairs.select("doc_id", once(scores, "s")).withColumn("dice", F.array_max(F.transform("s", lambda x: x["dice"])))
    best = scored.where(F.col("dice") >= least).select(
        "doc_id", "dice", F.array_min(F.transform(F.filter("s", lambda x: x["dice"] == F.col("dice")), lambda x: x["license"])).alias("license")
    )
    return best.groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("n_units"), F.max("dice").alias("dice"))


def scan_sql(least: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The same in SQL, without the pruning."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(name)}, {quoted(x)})" for i, (name, t) in enumerate(templates) for x in bigrams(t))
    return rf"""
WITH template(t, license, b) AS (VALUES {rows}),
t AS (SELECT *, sum(times) OVER (PARTITION BY t) AS n FROM (SELECT t, license, b, count(*) AS times FROM template GROUP BY ALL)),
tidy AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_replace(regexp_replace(lower(text), '[^a-z0-9.\n]+', ' ', 'g'), '\.+( |\n|$)', ' \1', 'g') AS x FROM documents),
units AS (SELECT r, 0 AS k, doc_id, x AS u FROM tidy WHERE contains(x, chr(10))
  UNION ALL SELECT r, generate_subscripts(string_split(x, chr(10)), 1), doc_id, unnest(string_split(x, chr(10))) FROM tidy),
words AS (SELECT r, k, doc_id, regexp_extract_all(u, '[^ \n]+') AS w FROM units),
pairs AS (SELECT r, k, doc_id, len(w) - 1 AS n, unnest(list_zip(w[:-2], w[2:])) AS p FROM words WHERE len(w) > 1),
grams AS (SELECT r, k, doc_id, n, p[1] || ' ' || p[2] AS b, count(*) AS times FROM pairs GROUP BY ALL),
scores AS (SELECT r, k, doc_id, license, t, round(2.0::DOUBLE * sum(least(grams.times, t.times)) / (any_value(grams.n) + any_value(t.n)), 6) AS dice
  FROM grams JOIN t USING (b) GROUP BY r, k, doc_id, license, t),
best AS (SELECT r, k, doc_id, license, dice, row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, license) AS place
  FROM scores WHERE dice >= {least})
SELECT doc_id, license, count(*) AS n_units, max(dice) AS dice FROM best WHERE place = 1 GROUP BY doc_id, license
"""
