"""Licence scans: a trained paragraph classifier whose predictions a template comparison confirms.

Paragraphs are lines; longer ones are read in windows of WINDOW words, half overlapping, so every word is
seen. A multinomial logistic regression over sparse word n-grams (one and two words, from the templates)
plus the share of words that no template knows gives each window a probability per licence family and for
``unknown``. It is trained on variations of the templates and, for ``unknown``, on a bounded sample of the
corpus (NEGATIVES windows of SAMPLE documents, by the smallest hashes; those that hold half of a template are left out, the rest
is labelled unknown) and on sentences that use licence words for other things. A temperature fitted on held-out variations calibrates it; a family is
predicted only if its probability reaches SURE. A prediction counts if the window's word pairs are CONFIRM
contained in one of the family's templates, or that template in the window.

A short notice in a long line is diluted in a full window, so windows of the lengths of the templates (of
at most half a WINDOW) are scored too, from every word pair that a template holds. Such a window counts if
CONFIRM of a template's pairs lie in it, and inside a hit of another family only if all do. Windows without
a template's pair could not be confirmed and are not scored.

Defined edge cases: null and empty texts have no licence; repeated rows give repeated results; ties between
families go to the first by name; an empty table gives an empty result and trains on the templates alone;
extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, tidy
from .learn import fit_softmax, softmax

SAMPLE, NEGATIVES, VARIATIONS = 400, 4000, 120
WINDOW, SURE, CONFIRM, SEED = 48, 0.8, 0.6, 10
#: A word in the templates of this many families tells none of them apart.
SHARED = 4

# Notices by family.
TEMPLATES = {
    "agpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPLv3."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "This project is distributed under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc0": ("This work has been dedicated to the public domain under the CC0 1.0 Universal dedication.", "Released under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered software released into the public domain."),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the GNU GPL v3.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only"),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,", "Licensed under the MIT license.", "This project is distributed under the terms of the MIT License.", "SPDX-License-Identifier: MIT"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.", "Copyright. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
}
# Sentences that use licence words without granting a licence.
OTHER_USES = (
    "The driver lost her license after the accident.", "Please read the terms and conditions before you continue.", "Version 2.0 of the application was released in May.",
    "The general public was informed under the new rules.", "He worked on this project at MIT for three years.", "Permission denied while opening the file.", "The software is free for students.",
    "A license plate was found under the bridge.", "All seats are reserved.", "The source of the river lies in the mountains.", "She published this work in the public domain of ideas.",
    "The creative director praised the commons.", "This work took four years.", "You may obtain a copy at the front desk.", "The Apache helicopter landed.", "This library is open until nine.", "The foundation is published as a book.",
)

TOKEN = re.compile(r"[^\W_]+")
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def grams(tokens: list[str]) -> list[str]:
    return [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))]


def pairs(tokens: list[str]) -> frozenset[tuple[str, str]]:
    return frozenset(zip(tokens, tokens[1:], strict=False))


def windows(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the windows of every line; offsets in code points."""
    at = 0
    for line in text.split("\n"):
        found = list(TOKEN.finditer(line))
        for i in range(0, max(1, len(found) - WINDOW // 2), WINDOW // 2) if found else ():
            part = found[i : i + WINDOW]
            yield at + part[0].start(), at + part[-1].end(), [m[0].lower() for m in part]
        at += len(line) + 1


def vary(tokens: list[str], rng: random.Random, fill: list[str], common: frozenset[str] = frozenset()) -> list[str]:
    """A variation: common words lost or replaced, the end cut off, foreign words around; words that tell families apart stay."""
    cut = tokens[: rng.randint(max(3, len(tokens) // 2), len(tokens))] if rng.random() < 0.4 and len(tokens) > 3 else tokens
    out = [rng.choice(fill) if fill and t in common and rng.random() < 0.03 else t for t in cut if len(cut) < 6 or t not in common or rng.random() > 0.05]
    extra = [rng.choice(fill) for _ in range(rng.choice((0, 0, 0, 2, 6)))] if fill else []
    return [*extra, *out] if rng.random() < 0.5 else [*out, *extra]


@dataclass(frozen=True)
class Model:
    slots: dict[str, int]
    weights: np.ndarray
    temperature: float
    templates: tuple[tuple[frozenset, ...], ...]
    pairs: frozenset = frozenset()
    lengths: tuple[int, ...] = ()

    def features(self, tokens: list[str]) -> tuple[list[int], float, float]:
        """(slots of the known n-grams, their value, share of words that no template knows)."""
        known = {s for g in grams(tokens) if (s := self.slots.get(g)) is not None}
        strange = sum(t not in self.slots for t in tokens) / max(1, len(tokens))
        return sorted(known), 1 / max(1.0, len(known)) ** 0.5, strange

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        at, value, strange = self.features(tokens)
        z = self.weights[at].sum(0) * value + strange * self.weights[-2] + self.weights[-1]
        return softmax(z[None] / self.temperature)[0]

    def family(self, tokens: list[str]) -> tuple[str, float, float]:
        """(family or unknown, calibrated probability, how far a template confirms it)."""
        p = self.probabilities(tokens)
        k = int(p.argmax())
        if FAMILIES[k] == UNKNOWN or p[k] < SURE:
            return UNKNOWN, float(p[-1]), 0.0
        own = pairs(tokens)
        match = max((len(own & t) / max(1, min(len(own), len(t))) for t in self.templates[k]), default=0.0)
        return (FAMILIES[k] if match >= CONFIRM else UNKNOWN), float(p[k]), match


def train(paragraphs: list[list[str]]) -> Model:
    """From the templates and paragraphs of the corpus; those that hold half of a template are not negatives."""
    rng = random.Random(SEED)
    notices = [[words(t) for t in group] for group in TEMPLATES.values()]
    slots = {g: i for i, g in enumerate(dict.fromkeys(g for group in notices for t in group for g in grams(t)))}
    templates = tuple(tuple(pairs(t) for t in group) for group in notices)
    every = [t for group in templates for t in group]
    clean = [p for p in paragraphs if not any(len(pairs(p) & t) >= max(2, len(t) / 2) for t in every)]
    rng.shuffle(clean)
    fill = [w for p in clean[:200] for w in p] or ["the", "of", "and"]
    known = [{w for t in group for w in t} for group in notices]
    common = frozenset(w for w in set().union(*known) if sum(w in k for k in known) >= SHARED)
    rows = [(vary(rng.choice(group), rng, fill, common), k) for k, group in enumerate(notices) for _ in range(VARIATIONS)]
    rows += [(t, k) for k, group in enumerate(notices) for t in group for _ in range(5)]
    unknown = len(FAMILIES) - 1
    rows += [(p, unknown) for p in clean[:NEGATIVES]]
    rows += [(vary(words(rng.choice(OTHER_USES)), rng, fill), unknown) for _ in range(400)]
    blank = Model(slots, np.zeros((len(slots) + 2, len(FAMILIES)), np.float32), 1.0, templates)
    x, y = np.zeros((len(rows), len(slots) + 1), np.float32), np.array([k for _, k in rows])
    for i, (tokens, _) in enumerate(rows):
        at, value, strange = blank.features(tokens)
        x[i, at], x[i, -1] = value, strange
    share = np.bincount(y, minlength=len(FAMILIES))
    weight = (1 / share[y]) * np.where(y == unknown, 4.0, 1.0)
    held = np.arange(len(rows)) % 5 == 0
    w = fit_softmax(x[~held], y[~held], len(FAMILIES), weight[~held], l2=1e-5, steps=400)
    z = np.concatenate([x[held], np.ones((held.sum(), 1), np.float32)], 1) @ w
    loss = {t: float(-(weight[held] * np.log(softmax(z / t)[np.arange(len(z)), y[held]] + 1e-12)).sum()) for t in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)}
    lengths = {len(t) for group in notices for t in group if len(t) <= WINDOW // 2}
    return Model(slots, w, min(loss, key=loss.get), templates, frozenset().union(*every), tuple(sorted(lengths | {3})))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """From the documents with the SAMPLE smallest hashes, and of their windows the NEGATIVES with the smallest hashes.

    Hashes choose both times, so that only chosen texts and windows travel: the driver gets NEGATIVES windows of WINDOW words at most.
    """
    rows = docs.select(F.xxhash64(F.lit(SEED), F.col(key)).alias("h"), F.xxhash64(F.lit(SEED), F.col(text)).alias("s"), F.col(text).alias("t")).where("t is not null")
    last = rows.select("h", "s").orderBy("h", "s").limit(SAMPLE).agg(F.max(F.struct("h", "s")).alias("last")).first()["last"]
    if last is None:
        return train([])
    chosen = rows.where(F.struct("h", "s") <= F.struct(F.lit(last.h).cast("long"), F.lit(last.s).cast("long"))).dropDuplicates(["h", "s"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for x in batch.column(0) for *_, w in windows(x.as_py())], pa.list_(pa.string()))], ["w"])

    found = chosen.select("t").mapInArrow(tidy(cut), "w array<string>").select("w", F.xxhash64(F.lit(SEED), "w").alias("h"))
    return train([list(r.w) for r in found.orderBy("h", "w").limit(NEGATIVES).collect()])


HITS = "array<struct<family:string,start:int,end:int,probability:double,match:double>>"


def short(tokens: list[str], model: Model) -> list[tuple[int, int, str, float, float]]:
    """(first word, last word + 1, family, probability, match) of windows as long as templates; of overlapping ones the best stays."""
    known = [i for i, x in enumerate(zip(tokens, tokens[1:], strict=False)) if x in model.pairs]
    found = []
    for i in known:
        for n in model.lengths:
            if i + n > len(tokens) or n == len(tokens):
                continue
            own = pairs(tokens[i : i + n])
            fits = [max(len(own & t) / max(1, len(t)) for t in group) for group in model.templates]
            if max(fits) < CONFIRM:
                continue
            p = model.probabilities(tokens[i : i + n])
            k = int(p.argmax())
            if FAMILIES[k] != UNKNOWN and p[k] >= SURE and fits[k] >= CONFIRM:
                found.append((i, i + n, FAMILIES[k], float(p[k]), fits[k]))
    best: list[tuple[int, int, str, float, float]] = []
    for x in sorted(found, key=lambda x: (-x[4], -x[3], x[0], x[1])):
        if all(x[1] <= y[0] or y[1] <= x[0] for y in best):
            best.append(x)
    return best


def scan(text: str | None, model: Model) -> list[dict]:
    """The confirmed windows of a text; overlapping windows of one family join."""
    hits = []
    for start, end, tokens in windows(text or ""):
        if not any(x in model.pairs for x in zip(tokens, tokens[1:], strict=False)):
            continue
        family, p, match = model.family(tokens)
        if family != UNKNOWN:
            hits.append((start, end, family, p, match))
        part = list(TOKEN.finditer(text, start, end))
        for i, j, other, q, fit_ in short(tokens, model):
            if family in (UNKNOWN, other) or fit_ == 1:
                hits.append((part[i].start(), part[j - 1].end(), other, q, fit_))
    out: list[dict] = []
    open_: dict[str, dict] = {}
    for start, end, family, p, match in sorted(hits, key=lambda x: (x[0], -x[1], x[2])):
        last = open_.get(family)
        if last and start <= last["end"]:
            last |= {"end": max(last["end"], end), "probability": max(last["probability"], p), "match": max(last["match"], match)}
        else:
            out.append({"family": family, "start": start, "end": end, "probability": p, "match": match})
            open_[family] = out[-1]
    return out


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, hits) for every document."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("match", pa.float64())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scan(x.as_py(), model) for x in batch.column(1)], kind)], ["key", "hits"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidy(run), f"key {kind}, hits {HITS}").withColumnRenamed("key", key)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(table(spark, sf_dir, "documents"))
    span = lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])
    return found.select("doc_id", F.size("hits").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct("hits.family")), ",").alias("families"), F.array_join(F.transform("hits", span), ",").alias("spans"))


QUERIES = {"op10_licences": op10_licences}
ORACLES: dict[str, str] = {}
