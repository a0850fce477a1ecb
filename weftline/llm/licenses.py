"""Licence scans: a paragraph classifier trained here on licence wordings and on the corpus, confirmed by the wordings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._words import MULT, hash_words, mix, owner, slices, split_words

#: Usual wordings of licence notices, by family.
WORDINGS = {
    "agpl": ["licensed under the GNU Affero General Public License version 3", "the terms of the GNU Affero General Public License as published by the Free Software Foundation", "AGPL-3.0 license"],
    "apache": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Use of this source code is governed by a BSD-style license", "released under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc0": ["dedicated to the public domain under the CC0 1.0 Universal dedication", "released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "This work is in the public domain"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "available under the Creative Commons Attribution License", "Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC-SA 4.0", "Licensed under CC BY-NC-ND 4.0"],
    "epl": ["made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "either version 2 of the License, or (at your option) any later version", "released under the GPL v2", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "released under the ISC License"],
    "lgpl": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "licensed under the LGPL version 2.1"],
    "mit": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0"],
    "proprietary": ["All rights reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher", "Unauthorized copying of this file, via any medium is strictly prohibited", "proprietary and confidential"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "released under The Unlicense"],
}
UNKNOWN = "unknown"
#: Hashed features (words and word pairs), corpus paragraphs drawn for training at about most, copies of each wording.
FEATURE_BITS, CORPUS_SAMPLE, COPIES = 16, 4000, 60
#: Least share of a wording's pairs in the paragraph, or of the paragraph's pairs in its family's wordings.
CONFIRMED = 0.6
_SIGNS = re.compile(r"[^\w.+-]+|\.(?!\d)|(?<!\w)-|-(?!\w)")


def plain(word: str) -> str:
    return re.sub(r"\d", "0", _SIGNS.sub("", word.lower()))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(offsets, hashes)``: words and pairs of neighbouring words of each text, as 64-bit hashes."""
    offsets, codes, words = split_words(texts)
    clean = [plain(w) for w in words.to_pylist()]
    real = np.array([bool(w) for w in clean], bool)
    keep = real[codes] if len(codes) else np.empty(0, bool)
    h = hash_words(clean)[codes[keep]] if len(clean) else np.empty(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    d = owner(ends)
    near = d[1:] == d[:-1] if len(d) else np.empty(0, bool)
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * MULT + h[1:])[near] if len(h) else h
    rows = np.concatenate([d, d[:-1][near] if len(d) else d])
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(len(ends))), np.concatenate([h, pairs])[order]


def _index(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def _pairs(texts: list[str]) -> list[set[int]]:
    """The hashes of word pairs of each text; of its words where it has no pair."""
    out = []
    for t in texts:
        w = [x for x in map(plain, t.split()) if x]
        out.append(set(zip(w, w[1:], strict=False)) if len(w) > 1 else {(x,) for x in w})
    return out


_KNOWN = {family: _pairs(texts) for family, texts in WORDINGS.items()}


def likeness(text: str, family: str) -> float:
    """How much of one wording of the family the text has, or for a longer text how much of it they have."""
    own = _pairs([text])[0]
    if not own:
        return 0.0
    covered = max(len(w & own) / len(w) for w in _KNOWN[family])
    within = len(own & set().union(*_KNOWN[family])) / len(own) if len(own) >= 6 else 0.0
    return max(covered, within)


@dataclass
class Classifier:
    """Softmax regression over hashed features; the last class is unknown."""

    classes: list[str]
    weight: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Mean feature weight scaled by the root of the number of features."""
        n = np.diff(offsets)
        z = np.zeros((len(n), len(self.classes)), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            z[some] = np.add.reduceat(self.weight[_index(h)], offsets[some])
        return z / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32) + self.bias

    def probabilities(self, offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = self.logits(offsets, h) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _variants(rng: np.random.Generator, text: str) -> str:
    """A part of a wording, with words lost and others around it."""
    w = text.split()
    if len(w) > 6:
        size = int(rng.integers(6, len(w) + 1))
        a = int(rng.integers(0, len(w) - size + 1))
        w = w[a : a + size]
    return " ".join(x for x in w if len(w) <= 3 or rng.random() > 0.06)


def fit(corpus: list[str], seed: int = 5, epochs: int = 12) -> Classifier:
    """Train on variants of all wordings and on corpus paragraphs, which are unknown unless a wording says otherwise.

    A fifth of the rows is held back, on which the temperature is chosen that makes probabilities fit best.
    """
    rng, classes = np.random.default_rng(seed), [*sorted(WORDINGS), UNKNOWN]
    corpus = [t for t in corpus if max(likeness(t, f) for f in WORDINGS) < CONFIRMED] or ["lorem ipsum dolor"]
    rows, labels = [], []
    for k, family in enumerate(classes[:-1]):
        for text in WORDINGS[family]:
            for i in range(COPIES):
                part = text if i % 4 == 0 else _variants(rng, text)
                around = corpus[rng.integers(len(corpus))].split()[: int(rng.integers(0, 12))] if i % 3 == 2 else []
                rows.append(" ".join([*around, part]))
                labels.append(k)
    rows += corpus
    labels += [len(classes) - 1] * len(corpus)
    offsets, h = features(pa.array(rows))
    y, at = np.array(labels), _index(h)
    model = Classifier(classes, np.zeros((1 << FEATURE_BITS, len(classes)), np.float32), np.zeros(len(classes), np.float32))
    order = rng.permutation(len(y))
    held, order = order[: len(y) // 5], order[len(y) // 5 :]
    square = np.full(1 << FEATURE_BITS, 1e-6, np.float32)
    for _ in range(epochs):
        for i in np.array_split(rng.permutation(order), max(1, len(order) // 64)):
            n = offsets[i + 1] - offsets[i]
            pos = np.concatenate([at[offsets[k] : offsets[k + 1]] for k in i])
            sub = np.concatenate([[0], np.cumsum(n)])
            z = np.zeros((len(i), len(classes)), np.float32)
            some = np.flatnonzero(n)
            z[some] = np.add.reduceat(model.weight[pos], sub[some])
            z = z / np.sqrt(np.maximum(n, 1))[:, None] + model.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            g = np.repeat(p / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
            np.add.at(square, pos, (g**2).sum(1))
            np.add.at(model.weight, pos, (-0.5 * g / np.sqrt(square[pos])[:, None]).astype(np.float32))
            model.bias -= (0.01 * p.sum(0)).astype(np.float32)
    part = [rows[k] for k in held]
    z, want = model.logits(*features(pa.array(part))), y[held]
    loss = lambda t: float(np.mean(np.log(np.exp((z - z.max(1, keepdims=True)) / t).sum(1)) - (z - z.max(1, keepdims=True))[np.arange(len(want)), want] / t))
    model.temperature = min(np.geomspace(0.25, 4, 25), key=loss)
    return model


def corpus_paragraphs(docs: DataFrame, most: int = CORPUS_SAMPLE) -> list[str]:
    """One line of each of ``most`` documents at most, both drawn by a hash of id and text."""
    n = max(docs.count(), 1)
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("licence")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    lines = F.split("text", "\n")
    line = F.substring(F.get(lines, F.pmod(F.xxhash64("doc_id", "text", F.lit("line")), F.size(lines)).cast("int")), 1, 2000)
    drawn = docs.filter("text is not null").filter(u < 1.2 * most / n).select(u.alias("u"), line.alias("line"))
    rows = drawn.orderBy("u", "line").limit(most).collect()
    return sorted(r.line for r in rows if r.line and r.line.strip())


def scan(docs: DataFrame, model: Classifier | None = None, confirmed: float = CONFIRMED) -> DataFrame:
    """``doc_id, paragraph, family, probability, likeness`` of the lines in which a licence was found and confirmed.

    Lines are numbered from 0 in the whole text. A line is unknown where no family has more than half of the
    probability, or where the family's wordings don't confirm it. Null and empty texts have no lines; repeated rows
    give repeated results.
    """
    model = model or fit(corpus_paragraphs(docs.select("doc_id", "text")))
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** 16 x 15 weights, a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in slices(batches, 4 << 20):
            texts = [t.split("\n") if t else [] for t in batch.column("text").to_pylist()]
            lines = [x for t in texts for x in t]
            row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            number = np.concatenate([np.arange(len(t)) for t in texts]) if lines else np.empty(0, np.int64)
            p = m.probabilities(*features(pa.array(lines, pa.string())))
            best = p.argmax(1)
            out = []
            for k in np.flatnonzero((best < len(m.classes) - 1) & (p.max(1) > 0.5)):
                like = likeness(lines[k], m.classes[best[k]])
                if like >= confirmed:
                    out.append((int(row[k]), int(number[k]), m.classes[best[k]], float(p[k, best[k]]), like))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64())], ["doc_id", "paragraph", "family", "probability", "likeness"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, paragraph int, family string, probability double, likeness double")
