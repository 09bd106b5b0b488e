r"""Licence families by a trained paragraph classifier, with DataFrame operations only.

A line with a licence cue (a cue word or the name of a licence) is classified alone first. Where it
names no family alone, as a line of a hard-wrapped notice does, it is joined with its neighbours: up
to AFTER words that follow it, then also up to BEFORE words that precede it, never beyond a line
without letters and digits or a line that names its family alone. The word unigrams and bigrams of
such a unit meet the weights of a sparse multinomial logistic regression, fitted on the driver on
fixed notices and names of each family and variants of them; the sum of weights and a softmax give
the family. A unit whose best probability is under the calibrated limit, that shares too little with
every notice of the predicted family and holds none of its names, or that lacks the family's marks,
is of the family `unknown`.

The stretch between two such bounds counts as one paragraph for each family that its joined lines
name; only where they name none, each of its cue lines counts as a paragraph of `unknown`.

Weights and notices are tables of a fixed bound (MAX_FEATURES rows), which is why they may be
broadcast. Equal units are classified once.

Defined results: null and blank texts and texts without a cue have no licence; a text with the
same licence in many paragraphs names it once and counts each paragraph; repeated rows give a row
each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize

CUE = (
    r"(?i)licen[cs]e|copyright|permission|redistribut|warrant|spdx|public domain|creative commons|all rights"
    r"|\bcc[ -]?by(?:[ -](?:nc|sa|nd)\b|[ -]?\d)|\bcc0\b|\b[al]?gpl(?:v?\d|\b)|\bapache[ -]v?2\.0\b|\bmpl[ -]?v?\d|\bbsd[ -]\d-clause"
)
#: Words joined to a cue line that names no family alone (the longest notice has 36).
AFTER, BEFORE = 48, 32
TOKEN = r"[a-z0-9]+"
MAX_FEATURES = 4_096
#: Short notices by family (fixed values of the public licences).
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "SPDX-License-Identifier: GPL-2.0-only"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License.", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause"],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
#: Names by family; unlike a notice, a name must stand whole.
NAMES = {
    "apache-2.0": ["Apache-2.0", "Apache License 2.0", "Apache License Version 2.0"],
    "mit": ["MIT License"],
    "gpl-3.0": ["GPL-3.0", "GPLv3", "GPL v3", "GNU General Public License v3.0", "GNU General Public License version 3"],
    "gpl-2.0": ["GPL-2.0", "GPLv2", "GPL v2", "GNU General Public License v2.0", "GNU General Public License version 2"],
    "lgpl": ["LGPL", "LGPLv2", "LGPLv3", "GNU Lesser General Public License"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause", "BSD License"],
    "isc": ["ISC License"],
    "mpl-2.0": ["MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License version 2.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0"],
    "cc-by-4.0": ["CC BY 4.0"],
    "public-domain": ["CC0", "Unlicense"],
}
#: Words and bigrams of which one must stand in a unit of the family, where families share most of a notice.
MARKS = {
    "gpl-3.0": ["version 3", "license v3", "gpl 3", "gpl v3", "gplv3"],
    "gpl-2.0": ["version 2", "license v2", "gpl 2", "gpl v2", "gplv2"],
    "lgpl": ["gnu lesser", "gnu library", "lgpl", "lgplv2", "lgplv3"],
    "cc-by-nc-4.0": ["nc", "noncommercial"],
    "cc-by-sa-4.0": ["sa", "sharealike"],
}
#: Lines with a cue that name no licence, or one of another family.
OTHER = ["Copyright 2020 the authors. All rights reserved.", "A driving license is needed for this work.", "No permission was given to enter the house.", "The warranty of the machine ended last year.", "The bar lost its license under the new law.", "All rights to the song belong to the band.", "They asked for permission to use the road free of charge.", "The copyright law of the country was changed.", "Redistribution of wealth is a matter of debate.", "This software is proprietary and may not be copied without a license.", "The public domain of ideas is large.", "licensed to the public for a fee in version 7", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-ND 4.0", "AGPL-3.0", "AGPLv3", "GNU Affero General Public License version 3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"]
UNKNOWN = "unknown"


def ngrams(text: str) -> list[str]:
    w = re.findall(TOKEN, text.lower())
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]))


def template(notice: str) -> list[str]:
    """The bigrams of a notice; a notice of one word has that word."""
    grams = ngrams(notice)
    return [g for g in grams if " " in g] or grams


def fit(seed: int = 3) -> tuple[dict[str, list[float]], list[str], float]:
    """(weights by feature, families with `unknown` last, calibrated limit)."""
    rng = random.Random(seed)
    families = [*NOTICES, UNKNOWN]
    filler = "the and of to that in was software work project file code version see more about our users data text name year".split()

    def variants(t: str, n: int):
        yield t
        for _ in range(n):
            w = [x for x in t.split() if rng.random() > 0.1]
            yield " ".join([*rng.choices(filler, k=rng.randrange(6)), *w, *rng.choices(filler, k=rng.randrange(6))])

    rows = [(v, i, k) for i, f in enumerate(families) for t in (OTHER if f == UNKNOWN else NOTICES[f] + NAMES[f]) for k, v in enumerate(variants(t, 15))]
    train, held = [r for r in rows if r[2] % 4 != 3], [r for r in rows if r[2] % 4 == 3]
    seen: dict[str, int] = {}
    for t, _, _ in train:
        for g in ngrams(t):
            seen[g] = seen.get(g, 0) + 1
    names = sorted(sorted(seen, key=lambda g: (-seen[g], g))[:MAX_FEATURES])
    index = {g: i for i, g in enumerate(names)}

    def matrix(rs):
        x = np.zeros((len(rs), len(names) + 1))
        x[:, -1] = 1
        for i, (t, _, _) in enumerate(rs):
            for g in ngrams(t):
                if g in index:
                    x[i, index[g]] = 1
        return x, np.array([r[1] for r in rs])

    x, y = matrix(train)
    w, hot = np.zeros((x.shape[1], len(families))), np.eye(len(families))[y]
    step = 2.0 / np.linalg.norm(x, 2) ** 2 * len(x)
    for _ in range(400):  # proximal gradient: the penalty makes weights exactly zero
        p = softmax(x @ w)
        w -= step * (x.T @ (p - hot)) / len(x)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - step * 2e-5, 0)
    xh, yh = matrix(held)
    p = softmax(xh @ w)
    sure = np.sort([p[i, : len(families) - 1].max() for i in range(len(yh)) if yh[i] == len(families) - 1])
    # the limit lets through at most 2 % of the held-out lines that name no licence
    limit = float(np.clip(sure[int(0.98 * (len(sure) - 1))] + 0.01, 0.3, 0.9))
    weights = {g: w[i].tolist() for g, i in index.items() if np.abs(w[i]).max() > 0}
    weights[""] = w[-1].tolist()
    return weights, families, limit


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def classify(lines: DataFrame, overlap: float = 0.6) -> DataFrame:
    """(line, family) for distinct lines (line)."""
    spark = lines.sparkSession
    weights, families, limit = fit()
    model = spark.createDataFrame([(g, *w) for g, w in weights.items()], "gram string, " + ", ".join(f"w{i} double" for i in range(len(families))))
    words = F.expr(f"regexp_extract_all(lower(line), '{TOKEN}', 0)")
    grams = lines.withColumn("__w", words).withColumn("grams", F.expr("array_distinct(concat(__w, transform(slice(__w, 2, greatest(size(__w) - 1, 0)), (x, i) -> concat(get(__w, i), ' ', x)), array('')))")).select("line", "grams")
    scored = grams.select("line", F.explode("grams").alias("gram")).join(F.broadcast(model), "gram").groupBy("line").agg(*[F.sum(f"w{i}").alias(f"z{i}") for i in range(len(families))])
    z = [F.col(f"z{i}") for i in range(len(families))]
    top = F.greatest(*z)
    total = sum((F.exp(c - top) for c in z), F.lit(0.0))
    guess = F.lit(UNKNOWN)
    for i in reversed(range(len(families) - 1)):
        guess = F.when((z[i] == top) & (1 / total >= limit), families[i]).otherwise(guess)
    scored = scored.select("line", guess.alias("guess"))
    # confirmation: the share of some notice's bigrams of that family found in the line, or all of some name's
    known = {f: [(template(t), overlap) for t in ts] + [(template(t), 1.0) for t in NAMES[f]] for f, ts in NOTICES.items()}
    notices = F.create_map(*[x for f, ts in known.items() for x in (F.lit(f), F.array(*[F.struct(F.array(*map(F.lit, t)).alias("t"), F.lit(need).alias("need")) for t, need in ts]))])
    sure = F.exists(notices[F.col("guess")], lambda n: F.size(F.array_intersect(n["t"], F.col("grams"))) / F.size(n["t"]) >= n["need"])
    for f, marks in MARKS.items():
        sure &= (F.col("guess") != f) | F.arrays_overlap("grams", F.array(*map(F.lit, marks)))
    both = scored.join(grams, "line")
    return both.select("line", F.when((F.col("guess") != UNKNOWN) & ~sure, UNKNOWN).otherwise(F.col("guess")).alias("family"))


def joined(some: DataFrame, alone: DataFrame) -> DataFrame:
    """(row, pos, part, narrow, wide) of the cue lines without a family of their own: their stretch
    and their texts with what follows, and with what precedes too."""
    per = alone.groupBy("row").agg(F.expr(f"collect_list(pos) filter (where family <> '{UNKNOWN}')").alias("known"), F.expr(f"collect_list(pos) filter (where family = '{UNKNOWN}')").alias("open")).filter(F.size("open") > 0)
    stops = F.expr("filter(sequence(0, size(lines) - 1), i -> array_contains(known, i) or not lines[i] rlike '[\\\\p{L}\\\\p{N}]')")
    cues = some.join(per, "row").withColumn("stops", stops).select("row", "lines", "stops", F.explode("open").alias("pos"))
    words = f"regexp_extract_all(lower(x), '{TOKEN}', 0)"
    cues = cues.withColumn("low", F.expr("coalesce(array_max(filter(stops, i -> i < pos)), -1)")).withColumn("high", F.expr("coalesce(array_min(filter(stops, i -> i > pos)), size(lines))"))
    cues = cues.withColumn("after", F.expr(f"slice(flatten(transform(slice(lines, pos + 2, least(high - pos - 1, {AFTER})), x -> slice({words}, 1, {AFTER}))), 1, {AFTER})"))
    cues = cues.withColumn("before", F.expr(f"reverse(slice(flatten(transform(reverse(slice(lines, greatest(low + 1, pos - {BEFORE}) + 1, least(pos - low - 1, {BEFORE}))), x -> slice(reverse({words}), 1, {BEFORE}))), 1, {BEFORE}))"))
    narrow = F.expr("concat_ws(' ', lines[pos], array_join(after, ' '))")
    return cues.select("row", "pos", F.col("low").alias("part"), narrow.alias("narrow"), F.concat_ws(" ", F.array_join("before", " "), narrow).alias("wide"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (with a licence cue), licenses (names in order, comma-joined)."""
    some = docs.filter(F.col("text").rlike(CUE)).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", "\n").alias("lines"))
    some = materialize(some, "licensed")
    lines = materialize(some.select("row", F.posexplode("lines").alias("pos", "line")).filter(F.col("line").rlike(CUE)), "cues")
    alone = materialize(lines.join(classify(lines.select("line").distinct()), "line").select("row", "pos", "family"), "families")
    texts = materialize(joined(some, alone), "joined")
    named = materialize(classify(texts.select(F.explode(F.array("narrow", "wide")).alias("line")).distinct()), "joined-families")
    sure = named.filter(F.col("family") != UNKNOWN)
    found = texts.join(sure.withColumnsRenamed({"line": "narrow", "family": "f"}), "narrow", "left").join(sure.withColumnsRenamed({"line": "wide", "family": "g"}), "wide", "left")
    # a stretch counts once for each family its joined lines name, or else once for each cue line
    parts = found.groupBy("row", "part").agg(F.collect_set(F.coalesce("f", "g")).alias("names"), F.count("*").alias("n"))
    named_parts = parts.filter(F.size("names") > 0).select("row", F.lit(1).alias("n"), F.explode("names").alias("family"))
    other_parts = parts.filter(F.size("names") == 0).select("row", "n", F.lit(UNKNOWN).alias("family"))
    every = alone.filter(F.col("family") != UNKNOWN).select("row", F.lit(1).alias("n"), "family").unionByName(named_parts).unionByName(other_parts)
    # by row: a doc_id may be null or stand on several texts
    per = every.groupBy("row").agg(F.sum("n").alias("n_paragraphs"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licenses"))
    out = some.select("row", "doc_id").join(per, "row", "left").drop("row").unionByName(docs.filter(~F.coalesce(F.col("text").rlike(CUE), F.lit(False))).select("doc_id", F.lit(None).alias("n_paragraphs"), F.lit(None).alias("licenses")))
    return out.select("doc_id", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("licenses", F.lit("")).alias("licenses"))


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
