"""Licence notices by a trained paragraph classifier, scored in Spark's own expressions.

A paragraph is a line of a document; a line is also scored with the lines after it up to a blank one, as far as
the longest template reaches, so that notices wrapped at any width are whole. Features are hashed word unigrams and bigrams. A multinomial
logistic regression over licence families and an unknown class is fitted on the driver from the templates
below, on passages cut from and put around them, and on at most ``MAX_OTHER`` ordinary paragraphs of the
corpus (those of the ``MAX_DOCUMENTS`` documents with the smallest hash); a temperature fitted on passages
that training did not see calibrates its probabilities. The model is a few hundred numbers and enters the
plan as literals, so the scan is one projection: no join, no exchange, no Python.

A prediction counts only if the family's probability reaches ``PROBABLE`` and one of its templates is
confirmed, that is, at least ``CONFIRMED`` of the template's features are in the paragraph. SPDX tags are read
as such: each identifier is a notice of its family, or of its own name if it belongs to none of them.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import let

SLOTS = 1 << 15
MAX_DOCUMENTS = 300
MAX_OTHER = 3_000
PROBABLE = 0.5
CONFIRMED = 0.6
UNKNOWN = "unknown"

# fixed values: notices as their licences word them
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License)",
        "you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.", "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    "AGPL": ("Licensed under the GNU Affero General Public License.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "Proprietary": ("All rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."),
}
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Words of the longest template.
REACH = max(len(re.findall(r"[^\W_]+", t)) for own in TEMPLATES.values() for t in own)
_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX = rf"(?i:SPDX-License-Identifier):\s*(\(*{_ID}\)*(?:\s+(?:AND|OR|WITH)\s+\(*{_ID}\)*)*)"
# fixed values: identifiers of a family
SPDX_FAMILIES = {
    "MIT": "MIT(-.*)?", "Apache-2.0": "Apache-2\\.0", "BSD": "(0?BSD|BSD-.*)", "GPL": "GPL-.*", "LGPL": "LGPL-.*", "AGPL": "AGPL-.*",
    "MPL-2.0": "MPL-2\\.0(-.*)?", "CC-BY": "CC-BY-[0-9].*", "CC-BY-SA": "CC-BY-SA-.*", "CC-BY-NC": "CC-BY-NC-[0-9].*", "CC0": "CC0-.*", "ISC": "ISC",
}
# fixed values: sentences near the subject that are no notices
OTHERS = (
    "She renewed her driving license last week.", "The council granted a licence to sell food.", "Permission to enter was denied.",
    "The software version was released in March.", "Copyright law is a difficult subject.", "General public opinion has changed.",
    "Public version of the general work, released under pressure.", "The terms of the contract were published.",
)


def words_of(paragraph: Column) -> Column:
    """Words in lower case and without punctuation."""
    return F.array_remove(F.split(F.lower(paragraph), r"[^\p{L}\p{N}]+"), "")


def features(words: Column) -> Column:
    """Hashes of the unigrams and bigrams of a paragraph's words."""
    none = F.array().cast("array<bigint>")
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(w[i], w[i + 1]))).otherwise(none)
    return let(words, lambda w: F.concat(F.transform(w, lambda x: F.xxhash64(x)), pairs(w)))


@dataclass
class Model:
    weights: np.ndarray  # (slots in use, families)
    bias: np.ndarray
    slots: list[int]  # the feature (a hash) of each row of weights
    templates: list[list[list[int]]]  # features of each template of each family


def _others(docs: DataFrame) -> DataFrame:
    some = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(MAX_DOCUMENTS)
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.orderBy(F.xxhash64("line"), "line").limit(MAX_OTHER)


def _slots(lines: DataFrame) -> DataFrame:
    return lines.select("*", F.array_distinct(features(words_of(F.col("line")))).alias("slots"))


def fit(docs: DataFrame, seed: int = 17) -> Model:
    """Works without any document: the templates and the fixed sentences are enough to train on."""
    spark: SparkSession = docs.sparkSession
    other = [r["line"] for r in _others(docs).collect()]
    rng = random.Random(seed)
    # a nonsense word is as good a neighbour as any; long lines would drown the notice
    vocabulary = sorted({w for line in other[:400] for w in line.split()[:12]}) or ["and"]
    rows: list[tuple[int, str, bool, int]] = []  # family, line, held out, template
    for k, texts in enumerate(TEMPLATES.values()):
        for t, text in enumerate(texts):
            rows.append((k, text, False, t))
            words = text.split()
            for n in range(12):
                keep = rng.randint(max(2, (7 * len(words) + 9) // 10), len(words))
                at = rng.randint(0, len(words) - keep)
                around = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 6))] for _ in range(2)]
                rows.append((k, " ".join([*around[0], *words[at : at + keep], *around[1]]), n % 4 == 0, -1))
    unknown = len(TEMPLATES)
    rows += [(unknown, line, i % 4 == 0, -1) for i, line in enumerate([*OTHERS, *OTHERS, *other])]
    frame = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "n int, line string")
    found = {r["n"]: r["slots"] for r in _slots(frame).select("n", "slots").collect()}
    templates = [[found[i] for i, r in enumerate(rows) if r[0] == k and r[3] >= 0] for k in range(unknown)]
    # an ordinary paragraph that holds a whole template is a notice, not a counterexample
    covered = lambda s: any(len(set(t) & s) >= CONFIRMED * len(t) for own in templates for t in own)
    used = [i for i, r in enumerate(rows) if r[0] != unknown or not covered(set(found[i]))]
    # the features of the templates; of two in one slot of the lookup table the smaller stays
    slots = list({s % SLOTS: s for s in sorted({s for own in templates for t in own for s in t}, reverse=True)}.values())
    templates = [[[s for s in t if s in set(slots)] for t in own] for own in templates]
    place = {s: j for j, s in enumerate(slots)}
    x = np.zeros((len(used), len(slots)))
    for n, i in enumerate(used):
        x[n, [place[s] for s in found[i] if s in place]] = 1
    y = np.eye(len(FAMILIES))[[rows[i][0] for i in used]]
    train = np.array([not rows[i][2] for i in used])
    weights, bias = _regression(x[train], y[train])
    heat = _temperature(x[~train] @ weights + bias, y[~train])
    return Model(weights / heat, bias / heat, slots, templates)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated gradient ascent; every class weighs the same in total."""
    share = (1 / y.sum(axis=0))[y.argmax(axis=1)][:, None] / y.shape[1]
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    vw, vb = w.copy(), b.copy()
    for _ in range(steps):
        gap = share * (y - _softmax(x @ w + b))
        vw = 0.9 * vw + 2.0 * (x.T @ gap - ridge * w)
        vb = 0.9 * vb + 2.0 * gap.sum(axis=0)
        w, b = w + vw, b + vb
    return w, b


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the best likelihood on passages not trained on."""
    tried = np.geomspace(0.25, 8, 41)
    loss = [-np.log(np.maximum((_softmax(z / t) * y).sum(axis=1), 1e-12)).mean() for t in tried]
    return float(tried[int(np.argmin(loss))]) if len(z) else 1.0


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def classify(words: Column, model: Model) -> Column:
    """struct(family, probability, coverage) of a paragraph's words. The family is ``unknown`` unless it is probable
    and confirmed; a paragraph without any feature of the model is unknown with the bias alone."""
    rank = [0] * SLOTS
    for j, s in enumerate(model.slots):
        rank[s % SLOTS] = j + 1
    ranks = _literal(rank, "array<int>")
    hashes = _literal(model.slots, "array<bigint>")
    table = _literal([round(float(v), 6) for row in model.weights for v in row], "array<double>")
    bias = _literal([round(float(v), 6) for v in model.bias], "array<double>")
    templates = _literal([[sorted({model.slots.index(s) + 1 for s in t}) for t in own] for own in model.templates], "array<array<array<int>>>")
    n = len(FAMILIES)
    names = _literal(list(FAMILIES), "array<string>")

    def rated(hits: Column) -> Column:
        logits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(
            hits, F.get(bias, k), lambda total, h: total + F.get(table, (h - 1) * n + k)))
        return let(logits, lambda z: let(F.array_max(z), lambda top: _decided(z, top, hits)))

    def _decided(z: Column, top: Column, hits: Column) -> Column:
        family = (F.array_position(z, top) - 1).cast("int")
        share = 1 / F.aggregate(z, F.lit(0.0), lambda total, v: total + F.exp(v - top))
        own = F.coalesce(F.get(templates, family), F.array().cast("array<array<int>>"))
        best = F.aggregate(own, F.lit(0.0), lambda most, t: F.greatest(most, F.size(F.array_intersect(t, hits)) / F.size(t)))
        return let(F.struct(family.alias("k"), share.alias("p"), best.alias("c")), lambda r: F.struct(
            F.when((r["p"] >= PROBABLE) & (r["c"] >= CONFIRMED), F.get(names, r["k"])).otherwise(UNKNOWN).alias("family"),
            F.round(r["p"], 4).alias("probability"), F.round(r["c"], 4).alias("coverage")))

    # features the model does not know add nothing to any class
    place = lambda h: F.get(ranks, F.pmod(h, F.lit(SLOTS)).cast("int"))
    same = lambda h: F.when(place(h) > 0, F.get(hashes, place(h) - 1) == h).otherwise(False)
    known = lambda f: F.array_distinct(F.transform(F.filter(f, same), place))
    nothing = F.struct(F.lit(UNKNOWN).alias("family"), F.lit(0.0).alias("probability"), F.lit(0.0).alias("coverage"))
    return let(known(features(words)), lambda hits: F.when(F.size(hits) > 0, rated(hits)).otherwise(nothing))


def joined(words: Column, i: Column) -> Column:
    """The end of line ``i`` and the start of the lines after it up to one without words: all of any template
    that begins in the line and goes on below. Empty if nothing follows."""
    below = F.slice(words, i + 2, F.lit(REACH))
    stop = lambda b: F.coalesce(F.nullif(F.array_position(F.transform(b, lambda w: F.size(w) == 0), True), F.lit(0)) - 1, F.size(b))
    after = let(below, lambda b: F.slice(F.flatten(F.transform(F.slice(b, F.lit(1), stop(b).cast("int")), lambda w: F.slice(w, 1, REACH))), 1, REACH))
    own = F.get(words, i)
    end = F.slice(own, F.greatest(F.size(own) - REACH, F.lit(0)) + 1, F.lit(REACH))
    return let(after, lambda t: F.when((F.size(own) > 0) & (F.size(t) > 0), F.concat(end, t)).otherwise(F.array().cast("array<string>")))


def tagged(line: Column) -> Column:
    """Families of a line's SPDX tags; exceptions after WITH are no licence."""
    tags = F.regexp_replace(F.array_join(F.regexp_extract_all(line, F.lit(SPDX), F.lit(1)), " "), rf"\bWITH\s+\(*{_ID}", "")
    ids = F.filter(F.regexp_extract_all(tags, F.lit(_ID), F.lit(0)), lambda s: ~s.isin("AND", "OR"))

    def family(name: Column) -> Column:
        named = name
        for own, pattern in SPDX_FAMILIES.items():
            named = F.when(name.rlike(f"(?i)^{pattern}$"), own).otherwise(named)
        return named

    return F.when(line.rlike(SPDX), F.array_distinct(F.transform(ids, family))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, model: Model, text: str = "text", into: str = "_licences") -> DataFrame:
    """``docs`` with the notices of each whole text: array of (paragraph, family, probability, coverage).

    Paragraphs are numbered from 0; a notice over several lines has the number of the first. It counts where no
    line it starts in is a notice by itself, and where neither the line before begins a better one of its family
    nor the next as good a one. Null and empty texts have no notice.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rated = lambda words: F.transform(words, lambda w, i: F.struct(
        classify(w, model).alias("one"), classify(joined(words, i), model).alias("more")))

    def notice(r: Column, before: Column, after: Column) -> Column:
        found = lambda x: x["family"] != UNKNOWN
        again = lambda x: (x["family"] == r["more"]["family"]) & (x["coverage"] >= r["more"]["coverage"])
        earlier = (before["more"]["family"] == r["more"]["family"]) & (before["more"]["coverage"] > r["more"]["coverage"])
        later = (after["one"]["family"] == r["more"]["family"]) | again(after["more"])
        return F.when(found(r["one"]), r["one"]).when(found(r["more"]) & ~F.coalesce(earlier, F.lit(False)) & ~F.coalesce(later, F.lit(False)), r["more"])

    def of_line(r: Column, i: Column, all_: Column, line: Column) -> Column:
        as_notice = lambda n: F.struct(i.alias("paragraph"), n["family"].alias("family"), n["probability"].alias("probability"), n["coverage"].alias("coverage"))
        tags = F.transform(tagged(line), lambda t: F.struct(
            i.alias("paragraph"), t.alias("family"), F.lit(1.0).alias("probability"), F.lit(1.0).alias("coverage")))
        said = let(notice(r, F.get(all_, i - 1), F.get(all_, i + 1)), lambda n: F.when(n.isNotNull(), F.array(as_notice(n))).otherwise(
            F.slice(F.array(as_notice(r["one"])), 1, 0)))
        return F.when(F.size(tags) > 0, tags).otherwise(said)

    notices = let(lines, lambda ls: let(F.transform(ls, words_of), lambda words: let(rated(words), lambda all_: F.flatten(
        F.transform(all_, lambda r, i: of_line(r, i, all_, F.get(ls, i)))))))
    return docs.withColumn(into, notices)
