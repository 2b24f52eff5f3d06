"""Licence scan: a paragraph classifier over word n-grams, confirmed by templates.

A paragraph is a line together with the lines after it for as long as the one
before does not end a sentence (by ``.``, ``!`` or ``?``) and none is
blank, so a notice wrapped over lines is judged whole. A sparse softmax regression over runs of one to
three words gives each paragraph a licence family or "unknown"; a family counts
when its calibrated probability is ``CERTAINTY`` or more and the paragraph holds
``COVERAGE`` of the n-grams of one of the family's templates.

Only n-grams with a cue word (a word of the templates that the background lacks)
are features, so a paragraph without one has no feature, is unknown by
construction, and is passed over early. The classifier is trained here, in plain
Python on the templates below and on variants of them; documents meet it as a
broadcast table of fixed size, in DataFrame expressions only.

Defined results: one row for each distinct document id (a null id among them);
rows with equal ids are taken together; equal paragraphs of a document count
once; a null or empty text has no paragraphs; a very long one is cut into its
paragraphs; of families with the same probability the first of the table counts;
an empty table gives no row. Extra columns, of whatever names, are not read.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
CERTAINTY, COVERAGE = 0.7, 0.5
#: Variants made of each template and of each background sentence for training, and as many for calibration.
VARIANTS = 24

#: Usual notices of each family (fixed texts).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "MIT licensed.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is covered by the GPLv3.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the LGPL.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Distributed under the AGPL.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under the CC0 dedication.",
    ],
}

#: Sentences that are no licence notice, some of them near one (fixed texts).
BACKGROUND = [
    "The driver renewed the license at the office in the city.",
    "Researchers at MIT released a study of public transport this week.",
    "The Apache people lived in the south west for a long time.",
    "A version of the general plan was published under the terms of the council.",
    "You can use this file to copy the source of the river to a map.",
    "The software was free of charge for any person in the school.",
    "Permission to build was granted to the owner of the house in 2.0 days.",
    "The commons is a creative room in the town, and the work was international.",
    "The public library is open in the morning, and the author was there by 4.",
    "All rights of the person are subject to law, without restriction.",
    "License plates are sold in binary forms, the following conditions of sale are met.",
    "The gnu is a large animal, a general rule of the public park.",
    "The library published a source of modification, provided that the code is later than 3.",
    "A licensed doctor worked under the terms of the agreement with the company.",
    "The foundation gave the documentation to the related domain of the possible program.",
    "This site is distributed to the extent that the copy is associated with the files.",
]
#: Notices of licences that are none of the families (fixed texts); they are unknown, however near they are to one.
OTHERS = [
    "Distributed under the ISC license.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Licensed under the EUPL, version 1.2.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Licensed under the Artistic License 2.0.",
    "Released under the zlib license.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This work is licensed under the Open Font License, version 1.1.",
    "Licensed under the Common Development and Distribution License, version 1.0.",
    "Released under the Microsoft Public License.",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "License: Proprietary",
    "License: Unlicense",
    "This software is licensed under the terms of the vendor license agreement.",
    "Licensed under the Business Source License 1.1.",
    "All rights reserved. Unauthorized copying of this software is not permitted.",
    "Licensed under the Academic Free License version 3.0.",
    "This library is licensed under the PostgreSQL license.",
]
#: Short names of each family, and of other licences, other versions of a family's among them (fixed texts).
SHORT = {
    "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License 2.0"],
    "MIT": ["MIT", "MIT License"],
    "GPL": ["GPL", "GPL-2.0-only", "GPL-3.0-or-later", "GPL v2", "GPL v3", "GPLv2", "GPLv3"],
    "LGPL": ["LGPL", "LGPL-2.1", "LGPL-3.0-only", "LGPL v3"],
    "AGPL": ["AGPL", "AGPL-3.0", "AGPL v3"],
    "BSD": ["BSD", "BSD-2-Clause", "BSD-3-Clause"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0"],
    "CC-BY": ["CC-BY-4.0", "CC BY 4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC BY-SA 4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC 4.0"],
    "CC0": ["CC0-1.0", "CC0 1.0", "CC0"],
}
OTHER_SHORT = [
    "MPL-1.1", "MPL 1.0", "Apache-1.1", "Apache 1.0", "Mozilla Public License Version 1.1", "Apache License, Version 1.1", "CC-BY-ND-4.0", "CC BY-ND 4.0", "CC-BY-NC-ND-4.0", "CC BY-NC-SA 4.0", "GFDL-1.3", "ISC", "EPL-2.0", "EUPL-1.2",
    "AFL-3.0", "OFL-1.1", "CDDL-1.0", "BSL-1.0", "BUSL-1.1", "Zlib", "MS-PL", "Artistic-2.0", "PostgreSQL", "Unlicense", "WTFPL", "QPL-1.0", "Creative Commons Attribution-NoDerivatives 4.0 International", "GNU Free Documentation License, version 1.3",
]
#: What short names stand in (fixed texts).
FORMS = ["SPDX-License-Identifier: {}", "License: {}", "{} licensed", "Licensed under {}.", "Distributed under the {} license."]
#: Variants made of a short notice.
SHORT_VARIANTS = 4
UNKNOWN = "unknown"


def notices() -> dict[str, list[str]]:
    """Each family's templates, short notices among them."""
    return {family: [*texts, *[form.format(name) for name in SHORT.get(family, ()) for form in FORMS if form.format(name) not in texts]] for family, texts in TEMPLATES.items()}


def others() -> list[str]:
    return [*OTHERS, *[form.format(name) for name in OTHER_SHORT for form in FORMS if form.format(name) not in OTHERS]]


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def grams(tokens: list[str], cues: frozenset[str]) -> set[str]:
    return {" ".join(tokens[k : k + n]) for n in range(1, GRAM + 1) for k in range(len(tokens) - n + 1) if cues & set(tokens[k : k + n])}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  #: the last is UNKNOWN
    cues: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]  #: of each n-gram, for each family
    bias: tuple[float, ...]
    templates: tuple[tuple[int, tuple[int, ...]], ...]  #: (family, n-grams)


def _variants(rng: random.Random, n: int) -> list[tuple[str, list[str]]]:
    """Notices and background sentences with words dropped, and others around them."""
    out = []
    outside = [w for s in BACKGROUND for w in words(s)]
    full = {t for texts in TEMPLATES.values() for t in texts} | {*BACKGROUND, *OTHERS}
    for family, texts in [*notices().items(), (UNKNOWN, BACKGROUND * 2), (UNKNOWN, [*OTHERS, *others()])]:
        for text in texts:
            for k in range(n if text in full else SHORT_VARIANTS):
                own = words(text)
                if k:
                    own = [w for w in own if rng.random() > (0.3 if texts[0] == BACKGROUND[0] else 0.08)]
                around = [rng.choice(outside) for _ in range(rng.choice([0, 0, 3, 12]))]
                cut = rng.randrange(len(around) + 1)
                out.append((family, around[:cut] + own + around[cut:]))
    # Lone cue words say nothing of a licence.
    singles = sorted({w for texts in TEMPLATES.values() for t in texts for w in words(t)})
    return out + [(UNKNOWN, [rng.choice(outside), w, rng.choice(outside)]) for w in singles for _ in range(2)]


@lru_cache(maxsize=1)
def train(seed: int = 11) -> Model:
    """Softmax regression by full gradient steps, with a temperature fitted on other variants."""
    rng = random.Random(seed)
    families = (*TEMPLATES, UNKNOWN)
    common = {w for s in BACKGROUND for w in words(s)}
    always = {"license", "licensed", "gnu", "mit", "apache", "commons", "creative", "library", "permission", "free", "distributed", "published", "binary", "domain"}
    cues = frozenset(w for texts in notices().values() for t in texts for w in words(t) if (w not in common or w in always) and not w.isdigit())
    parts = [_variants(rng, VARIANTS) for _ in range(2)]
    # What other licences are called are features as well: they speak against a family.
    cues |= {w for t in others() for w in words(t) if w not in common and not w.isdigit()}
    cues = frozenset(w for w in cues if len(w) > 2 or w in ("cc", "v2", "v3"))  # "as", "be", "or" and their like are cues of nothing
    seen = sorted({g for texts in [*notices().values(), others()] for t in texts for g in grams(words(t), cues)})
    place = {g: k for k, g in enumerate(seen)}

    def matrix(rows):
        x = np.zeros((len(rows), len(seen)))
        for r, (_, tokens) in enumerate(rows):
            x[r, [place[g] for g in grams(tokens, cues) if g in place]] = 1
        return x, np.eye(len(families))[[families.index(f) for f, _ in rows]]

    def softmax(z):
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    x, y = matrix(parts[0])
    w, b = np.zeros((len(seen), len(families))), np.zeros(len(families))
    b[-1] = 2.0  # what has no feature is unknown
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(400):
        error = (softmax(x @ w + b) - y) / len(x)
        dw, db = 0.9 * dw + x.T @ error + 1e-4 * w, 0.9 * db + error.sum(axis=0)
        w, b = w - 0.5 * dw, b - 0.5 * db
    x, y = matrix(parts[1])
    z = x @ w + b
    heat = min(np.linspace(0.5, 4, 36), key=lambda t: -np.log((softmax(z / t) * y).sum(axis=1) + 1e-12).mean())
    templates = tuple((f, tuple(sorted(place[g] for g in grams(words(t), cues)))) for f, name in enumerate(families[:-1]) for t in notices()[name])
    rounded = tuple(tuple(round(float(v / heat), 4) for v in row) for row in w)
    return Model(families, tuple(sorted(cues)), tuple(seen), rounded, tuple(round(float(v / heat), 4) for v in b), templates)


def classify(text: str, model: Model | None = None) -> tuple[str, float, float]:
    """(family or unknown, probability, coverage) of one paragraph; the definition, for tests."""
    model = model or train()
    place = {g: k for k, g in enumerate(model.vocabulary)}
    found = {place[g] for g in grams(words(text), frozenset(model.cues)) if g in place}
    z = [b + sum(model.weights[k][f] for k in found) for f, b in enumerate(model.bias)]
    p = [1 / sum(math.exp(min(700, other - own)) for other in z) for own in z]
    best = max(range(len(z) - 1), key=lambda f: (p[f], -f))
    cover = max(len(found & set(ids)) / len(ids) for f, ids in model.templates if f == best)
    return (model.families[best] if p[best] >= CERTAINTY and cover >= COVERAGE else UNKNOWN), p[best], cover


def _tokens(line: Column) -> Column:
    return F.split(F.lower(line), "[^a-z0-9]+")


def _table(spark: SparkSession, model: Model) -> DataFrame:
    """The classifier, of a size the templates fix."""
    rows = ", ".join(f"('{g}', {k}, array({', '.join(f'{v}D' for v in w)}))" for k, (g, w) in enumerate(zip(model.vocabulary, model.weights, strict=True)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(gram, gram_id, weights)")


def _grams() -> Column:
    """Distinct runs of one to GRAM words of the column ``tokens``."""

    def runs(n: int) -> Column:
        starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(1), F.size("tokens") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.array_join(F.slice("tokens", k, n), " "))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, GRAM + 1)]))


#: A line that does not end a sentence, and the line after it: one paragraph. Twice, as a match takes the first letter of the second line.
_WRAPPED = r"([^.!?\s])[ \t\r]*\n[ \t]*([^\s])"


def _paragraphs(text: str) -> Column:
    joined = F.coalesce(F.col(text), F.lit(""))
    for _ in range(2):
        joined = F.regexp_replace(joined, _WRAPPED, "$1 $2")
    return F.split(joined, "\n")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, family, probability and coverage of each distinct paragraph that has a cue word."""
    model = train()
    lines = docs.select(F.col(key).alias("key"), F.explode(_paragraphs(text)).alias("line"))
    cued = lines.where(F.exists(_tokens(F.col("line")), lambda w: w.isin(list(model.cues)))).dropDuplicates(["key", "line"])
    tokens = cued.withColumn("tokens", F.filter(_tokens(F.col("line")), lambda w: w != ""))
    runs = tokens.select("key", "line", F.explode(_grams()).alias("gram"))
    matched = runs.join(F.broadcast(_table(docs.sparkSession, model)), "gram")  # as large as the templates make it
    sums = matched.groupBy("key", "line").agg(F.collect_set("gram_id").alias("ids"), *[F.sum(F.col("weights")[f]).alias(f"z{f}") for f in range(len(model.families))])
    scored = sums.select("key", "line", "ids", F.array(*[F.col(f"z{f}") + F.lit(b) for f, b in enumerate(model.bias)]).alias("z"))
    known = F.slice("z", 1, len(model.families) - 1)
    scored = scored.withColumn("top", F.array_max(known)).withColumn("best", F.array_position(known, F.array_max(known)).cast("int") - 1)
    probability = F.lit(1.0) / F.aggregate("z", F.lit(0.0), lambda total, x: total + F.exp(F.least(F.lit(700.0), x - F.col("top"))))
    cover = F.greatest(*[F.when(F.col("best") == f, F.size(F.array_intersect("ids", F.lit(list(ids)))) / len(ids)).otherwise(0.0) for f, ids in model.templates])
    family = F.element_at(F.lit(list(model.families)), F.col("best") + 1)
    judged = scored.select("*", probability.alias("probability"), cover.alias("coverage"))
    return judged.select(F.col("key").alias(key), "line", F.when((F.col("probability") >= CERTAINTY) & (F.col("coverage") >= COVERAGE), family).otherwise(UNKNOWN).alias("family"), "probability", "coverage")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_paragraphs, n_notices (distinct paragraphs of a licence), families (in order, comma-joined) and the least probability of a notice."""
    whole = F.filter(_paragraphs(text), lambda w: F.trim(w) != "")
    kind = "struct<line:string,family:string,probability:double>"
    every = docs.select(F.col(key).alias("key"), F.size(whole).cast("long").alias("n_paragraphs"), F.lit(None).cast(kind).alias("x"))
    sure = F.when(F.col("family") != UNKNOWN, F.lit(True))  # no filter: it would be pushed down with all that "family" is made of
    notices = paragraphs(docs, key, text).select(F.col(key).alias("key"), F.lit(0).cast("long").alias("n_paragraphs"), F.when(sure, F.struct(F.lit("").alias("line"), "family", "probability")).cast(kind).alias("x"))
    found = every.unionByName(notices).groupBy("key").agg(F.sum("n_paragraphs").alias("n_paragraphs"), F.collect_list("x").alias("x"))
    return found.select(
        F.col("key").alias(key), "n_paragraphs", F.size("x").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("x", lambda n: n["family"]))), ",").alias("families"), F.round(F.array_min(F.transform("x", lambda n: n["probability"])), 6).alias("certainty"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql() -> str:
    """The same in DuckDB, with the trained weights."""
    model = train()
    n = len(model.families)
    table = ", ".join(f"('{g}', {k}, [{', '.join(map(str, w))}])" for k, (g, w) in enumerate(zip(model.vocabulary, model.weights, strict=True)))
    templates = ", ".join(f"({f}, {list(ids)})" for f, ids in model.templates)
    names = ", ".join(f"'{f}'" for f in model.families)
    cues = ", ".join(f"'{c}'" for c in model.cues)
    z = ", ".join(f"sum(w[{f + 1}]) + ({b}) AS z{f}" for f, b in enumerate(model.bias))
    p = ", ".join(f"1.0 / ({' + '.join(f'exp(least(700.0, z{o} - z{f}))' for o in range(n))})" for f in range(n - 1))
    return f"""
WITH m(gram, id, w) AS (VALUES {table}),
t(f, ids) AS (VALUES {templates}),
j AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{_WRAPPED}', '\\1 \\2', 'g'), '{_WRAPPED}', '\\1 \\2', 'g'), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line FROM j),
c AS (SELECT DISTINCT doc_id, line, list_filter(string_split_regex(lower(line), '[^a-z0-9]+'), lambda x: x <> '') AS tok FROM l),
k AS (SELECT * FROM c WHERE list_has_any(tok, [{cues}])),
g AS (SELECT DISTINCT doc_id, line, array_to_string(tok[i : i + s - 1], ' ') AS gram
      FROM k, unnest([1, 2, 3]) AS u(s), unnest(range(1, greatest(len(tok) - s + 2, 1))) AS v(i)),
z AS (SELECT doc_id, line, list(id) AS ids, {z} FROM g JOIN m USING (gram) GROUP BY doc_id, line),
p AS (SELECT doc_id, line, ids, [{p}] AS p FROM z),
b AS (SELECT doc_id, line, ids, list_max(p) AS probability, list_position(p, list_max(p)) - 1 AS best FROM p),
v AS (SELECT doc_id, line, best, probability, max(len(list_intersect(b.ids, t.ids)) / len(t.ids)) AS cover
      FROM b JOIN t ON t.f = b.best GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n_notices, array_to_string(list_sort(list_distinct(list([{names}][best + 1]))), ',') AS families, min(probability) AS certainty
      FROM v WHERE probability >= {CERTAINTY} AND cover >= {COVERAGE} GROUP BY doc_id),
d AS (SELECT doc_id, sum(len(list_filter(lines, lambda x: trim(x) <> '')))::BIGINT AS n_paragraphs FROM j GROUP BY doc_id)
SELECT d.doc_id, n_paragraphs, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(families, '') AS families, round(certainty, 6) AS certainty
FROM d LEFT JOIN n USING (doc_id)
"""
