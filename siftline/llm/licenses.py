"""Licence scans by a trained paragraph classifier.

Passages are classified by multinomial logistic regression over sparse word
unigrams and bigrams.  The classes are licence families and ``unknown``.  The
families' examples are variants of short notice templates (words dropped, years,
names and prefixes added); unknown is learnt from a bounded sample of the
corpus's own lines and from templates with their words shuffled.  A temperature
fitted on held-out examples calibrates the probabilities.

Lines that no blank line parts are read as one run of words, so that it does not
matter where a notice is wrapped.  A passage is a stretch of such a run, about as
long as a template or within one line, that holds enough of the template's
bigrams, and at least half of those that no other family's templates have.  Each
family for which there is such a passage is found if the classifier prefers it to
``unknown`` there; its probability is that of the family against ``unknown``, so
several licences in one sentence do not take it from each other.

Defined results: null and empty texts have no paragraphs and no families; a text
may have several families, sorted by name in ``families`` and by place in
``findings`` (of equal places, in the order of the templates); n_paragraphs counts
the lines that are not blank, and a finding names the line on which it begins.
Texts and lines of any length are scanned whole, repeated rows each for itself; an
empty table gives no rows and can be learnt from; input columns with an output's
name are replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unclash

UNKNOWN = "unknown"

#: Short public notices by licence family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the terms of the MIT license",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all copies",
        "SPDX-License-Identifier: ISC",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "SPDX-License-Identifier: Zlib",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "SPDX-License-Identifier: Unlicense",
    ],
    "Proprietary": [
        "All rights reserved. Unauthorized copying of this file is strictly prohibited",
        "Proprietary and confidential",
    ],
}

_TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph.lower())


@lru_cache(maxsize=1)
def _vocabulary() -> tuple[dict[str, int], dict[tuple[int, int], int], list[str]]:
    """Words of the templates from 1, their bigrams after them, and the classes."""
    words: dict[str, int] = {}
    pairs: dict[tuple[int, int], int] = {}
    for texts in TEMPLATES.values():
        for text in texts:
            for w in tokens(text):
                words.setdefault(w, len(words) + 1)
    for texts in TEMPLATES.values():
        for text in texts:
            ids = [words[w] for w in tokens(text)]
            for pair in zip(ids, ids[1:]):
                pairs.setdefault(pair, len(words) + 1 + len(pairs))
    return words, pairs, [*TEMPLATES, UNKNOWN]


def paragraph_features(toks: list[str]) -> tuple[set[int], set[tuple[int, int]]]:
    """Known word and bigram features of a paragraph, and its known bigrams."""
    words, pairs, _ = _vocabulary()
    ids = [words.get(t, 0) for t in toks]
    grams = {p for p in zip(ids, ids[1:]) if p in pairs}
    return {i for i in ids if i} | {pairs[p] for p in grams}, grams


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def probabilities(self, feats: set[int]) -> np.ndarray:
        z = self.bias.copy()
        if feats:
            i = np.fromiter(feats, np.int64, len(feats))
            z += self.weights[i].sum(0) / np.sqrt(len(i))
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _examples(unknown: list[str], rng: np.random.Generator, copies: int) -> list[tuple[set[int], int]]:
    """Variants of the templates, shuffled templates and corpus paragraphs, as features and class."""
    _, _, classes = _vocabulary()
    out = []
    filler = [w for p in unknown for w in tokens(p)] or ["project"]
    for c, (_, texts) in enumerate(TEMPLATES.items()):
        for text in texts:
            base = tokens(text)
            for _ in range(copies):
                kept = [w for w in base if rng.random() > 0.06] or base
                pad = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 8))]
                cut = int(rng.integers(0, len(pad) + 1))
                out.append((paragraph_features(pad[:cut] + kept + pad[cut:])[0], c))
            for _ in range(copies // 4):
                mixed = [base[i] for i in rng.permutation(len(base))]
                part = mixed[: max(1, len(mixed) // 2)]
                out.append((paragraph_features(part)[0], len(classes) - 1))
    out += [(paragraph_features(tokens(p))[0], len(classes) - 1) for p in unknown]
    return out


def train(unknown: list[str], seed: int = 2, copies: int = 40, epochs: int = 60, rate: float = 0.5, l2: float = 1e-4) -> Model:
    """Fit weights on four fifths of the examples and the temperature on the rest."""
    words, pairs, classes = _vocabulary()
    rng = np.random.default_rng(seed)
    data = _examples(unknown, rng, copies)
    order = rng.permutation(len(data))
    cut = len(data) * 4 // 5
    parts = [[data[i] for i in order[:cut]], [data[i] for i in order[cut:]]]
    size, k = 1 + len(words) + len(pairs), len(classes)
    w, b = np.zeros((size, k)), np.zeros(k)

    def flat(part):
        owner = np.repeat(np.arange(len(part)), [len(f) for f, _ in part])
        index = np.fromiter((i for f, _ in part for i in f), np.int64)
        value = 1 / np.sqrt(np.maximum(1, np.array([len(f) for f, _ in part])))
        return owner, index, value[owner], np.array([c for _, c in part])

    def logits(owner, index, value, y):
        z = np.zeros((len(y), k))
        np.add.at(z, owner, w[index] * value[:, None])
        return z + b

    def soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    weight = np.bincount([c for _, c in parts[0]], minlength=k)
    weight = (len(parts[0]) / np.maximum(1, weight)) ** 0.5
    for epoch in range(epochs):
        shuffled = rng.permutation(len(parts[0]))
        for chunk in np.array_split(shuffled, max(1, len(shuffled) // 256)):
            owner, index, value, y = flat([parts[0][i] for i in chunk])
            g = soft(logits(owner, index, value, y))
            g[np.arange(len(y)), y] -= 1
            g *= weight[y][:, None] / len(y)
            grad = np.zeros_like(w)
            np.add.at(grad, index, g[owner] * value[:, None])
            step = rate * 4 / (1 + epoch / 20)
            w -= step * (grad + l2 * w)
            b -= step * g.sum(0)
    owner, index, value, y = flat(parts[1])
    z = logits(owner, index, value, y)

    def loss(t):
        return -np.log(soft(z / t)[np.arange(len(y)), y] + 1e-12).mean()

    temperature = min(np.geomspace(0.25, 4, 25), key=loss) if len(y) else 1.0
    return Model(w, b, float(temperature))


@lru_cache(maxsize=1)
def _template_grams() -> dict[str, list[set[tuple[int, int]]]]:
    out = {}
    for family, texts in TEMPLATES.items():
        out[family] = [paragraph_features(tokens(t))[1] for t in texts]
    return out


@lru_cache(maxsize=1)
def _patterns() -> tuple[list[tuple[int, set, set, int]], dict[tuple[int, int], list[int]]]:
    """(class, bigrams, those of this family alone, length in words) of each template, and the templates of each bigram."""
    grams, out, of = _template_grams(), [], {}
    for c, (family, texts) in enumerate(TEMPLATES.items()):
        others = set().union(*[t for f, ts in grams.items() if f != family for t in ts])
        for text, t in zip(texts, grams[family]):
            for g in t:
                of.setdefault(g, []).append(len(out))
            out.append((c, t, t - others, len(tokens(text))))
    return out, of


_SPDX = "spdx-license-identifier"
#: A line up to this many words is one passage however its bigrams lie in it.
LINE = 256


def _words_of(lines: list[tuple[int, list[str]]]) -> tuple[list[str], list[int]]:
    """The words of consecutive lines, and the line of each; every licence of an SPDX expression gets the label."""
    toks, where = [], []
    for at, line in lines:
        if _SPDX in line:
            i, line = line.index(_SPDX) + 2, list(line)
            while i + 1 < len(line) and line[i] in ("or", "and"):
                line.insert(i + 1, _SPDX)
                i += 3
        toks += line
        where += [at] * len(line)
    return toks, where


def _passages(hits: list[tuple[int, tuple[int, int]]], where: list[int], grams: set, own: set, size: int, confirm: float):
    """(first word, end, share of the bigrams) of each passage that a template confirms, left to right."""
    need, reach, low = confirm * len(grams), 2 * size + 8, 0

    def near(a: int, b: int) -> bool:
        return b - a <= reach or where[a] == where[b] and b - a <= LINE

    r = 0
    while r < len(hits):
        while not near(hits[low][0], hits[r][0]):
            low += 1
        held = {g for _, g in hits[low : r + 1]}
        if len(held) >= need and 2 * len(held & own) >= len(own) > 0:
            # what else of the template follows belongs to the same passage
            while r + 1 < len(hits) and near(hits[low][0], hits[r + 1][0]) and hits[r + 1][1] not in held:
                r += 1
                held.add(hits[r][1])
            yield hits[low][0], hits[r][0] + 2, len(held) / len(grams)
            low = r + 1
        r += 1


def _findings(lines: list[tuple[int, list[str]]], model: Model, least: float, confirm: float) -> list[dict]:
    """Confirmed findings of consecutive lines."""
    words, _, classes = _vocabulary()
    patterns, of = _patterns()
    toks, where = _words_of(lines)
    ids = [words.get(t, 0) for t in toks]
    hits: dict[int, list] = {}
    for i, g in enumerate(zip(ids, ids[1:])):
        if g in of:
            for k in of[g]:
                hits.setdefault(k, []).append((i, g))
    spans: dict[int, list] = {}
    for k, at in hits.items():
        c, grams, own, size = patterns[k]
        if len({g for _, g in at}) < confirm * len(grams):
            continue
        for first, end, share in _passages(at, where, grams, own, size, confirm):
            p = model.probabilities(paragraph_features(toks[first:end])[0])
            sure = float(p[c] / (p[c] + p[-1]))
            if sure >= least:
                spans.setdefault(c, []).append((first, end, sure, share))
    found = []
    for c, own in spans.items():
        last = None
        for first, end, sure, share in sorted(own):  # templates of one family may meet in one notice
            if last and (first < last[1] or where[first] == where[last[0]]):
                last[1] = max(last[1], end)
                last[2], last[3] = max(last[2:], [share, sure], key=lambda x: (x[0], x[1]))
                continue
            last = [first, end, share, sure]
            found.append((c, last))
    return [
        {"paragraph": where[first], "family": classes[c], "probability": sure, "similarity": float(share)}
        for c, (first, _, share, sure) in sorted(found, key=lambda x: (x[1][0], x[0]))
    ]


def classify(text: str | None, model: Model, least: float, confirm: float) -> tuple[int, list[dict]]:
    """(number of paragraphs, confirmed findings) of a whole text."""
    n, found, block = 0, [], []
    for at, line in enumerate(text.split("\n") if text else ()):
        n += bool(line.strip())
        if toks := tokens(line):
            block.append((at, toks))
        elif block:
            found += _findings(block, model, least, confirm)
            block = []
    if block:
        found += _findings(block, model, least, confirm)
    return n, found


def fit(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample: int = 1500, lines: int = 9000, piece: int = 2000) -> Model:
    """Train with paragraphs of the corpus as the unknown class.

    The training text is a documented bound: the paragraphs of the `sample` documents
    with the smallest hashes, cut into pieces of at most `piece` characters (at a
    white space if there is one), and of those the `lines` with the smallest hashes.
    Pieces that hold more than half of a template's bigrams are left out: they may
    be what is looked for.
    """
    pattern = rf"(?s).{{1,{piece - 1}}}(?:\s|$)|.{{1,{piece}}}"
    chosen = df.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).distinct()
    said = df.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.explode(F.split(text_col, "\n")).alias("line"))
    said = said.select(F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("line"))
    found = [r[0] for r in said.orderBy(F.xxhash64("line"), "line").limit(lines).collect()]
    grams = [t for ts in _template_grams().values() for t in ts if t]

    def plain(line):
        own = paragraph_features(tokens(line))[1]
        return not own or max(len(own & t) / len(t) for t in grams) <= 0.5

    return train([x for x in found if plain(x)])


def scan(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.6, confirm: float = 0.6) -> DataFrame:
    """Append n_paragraphs, findings (array of structs) and families (sorted, distinct)."""
    used = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("n_paragraphs long, findings array<struct<paragraph:int,family:string,probability:double,similarity:double>>")
    def scanned(texts):
        import pyarrow as pa

        model, n, found = used.value, [], []
        for text in texts.to_pylist():
            k, f = classify(text, model, least, confirm)
            n.append(k), found.append(f)
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(found, kind)], ["n_paragraphs", "findings"])

    df = df.withColumn("__x", scanned(F.coalesce(F.col(text_col), F.lit(""))))
    df = unclash(df, "n_paragraphs", "findings", "families").select("*", "__x.*").drop("__x")
    return df.withColumn("families", F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["family"]))))
