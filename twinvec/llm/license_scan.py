"""License scan: a paragraph classifier over sparse word n-grams, confirmed by comparison with licence templates.

Softmax regression over hashed words and word pairs tells licence families, other licence-like text (``unknown``) and plain
text apart. It is trained on this module's templates, varied by a fixed random generator, against paragraphs of
the corpus without licence words. Half of those are held out to calibrate: a prediction needs a probability above
all but ``false_alarms`` of what the held-out paragraphs reach. A family is then confirmed by comparing words and word pairs with
its templates (a share of ``CONFIRM`` of a template); licence-like text that has only ``RELATED`` of one is ``unknown``, and
text that has less is plain.

Paragraphs are lines; longer ones are judged in overlapping stretches of ``STRETCH`` words, over the whole text, and a stretch is
compared with the templates together with up to ``AROUND`` words of its paragraph on either side. The model is a table
of ``FEATURES`` by number of classes, whatever the corpus; the negatives are at most ``negatives`` paragraphs, the ones with the smallest
hashes (a bounded sample, for training only).

Defined results: a null or empty text has no paragraphs and no licence; blank lines are no paragraphs; repeated rows are judged alike;
with an empty corpus the model is trained without negatives; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm import shingles as S
from twinvec.llm.registry import register, table

# Licence notices by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
        " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ],
    "unknown": [
        "All rights reserved. No part of this publication may be reproduced without permission of the publisher.",
        "Copyright by the authors. Use of this text is subject to the terms of the license agreement.",
        "Licensed under the terms of a separate license agreement.",
        "Released under a custom license; see the license terms.",
    ],
}
PLAIN = "plain"
CUES = "(?i)licen[sc]e|licensed|copyright|redistribut|all rights reserved|creative commons"
FEATURES, STRETCH, STEP, AROUND = 1 << 14, 16, 8, 24
NEGATIVES, VARIANTS, FALSE_ALARMS, CONFIRM, RELATED, SEED = 1500, 25, 0.03, 0.6, 0.3, 5
CHUNK = 1 << 20


def _clean(data: np.ndarray) -> np.ndarray:
    """Bytes with punctuation as blanks; a full stop stays inside a word (``2.0``)."""
    out = data.copy()
    out[np.isin(out, np.frombuffer(b",;:!?()[]{}\"'`*#|<>/", dtype=np.uint8))] = 32
    stop = np.flatnonzero(out == 46)
    after = np.append(out, 32)[stop + 1]
    out[stop[np.isin(after, [32, 9, 10, 11, 12, 13, 46])]] = 32
    return out


class Stretches:
    """Stretches of the paragraphs of some texts: ``text`` and ``paragraph`` numbers, first word and number of words, and word hashes."""

    def __init__(self, texts: pa.Array):
        data, ends = S.flat(texts)
        cuts = np.flatnonzero(data == 10) + 1
        line_ends = np.unique(np.concatenate([cuts, ends, [len(data)]]))
        line_ends = line_ends[line_ends > 0]
        self.h, counts = S.words(_clean(data), line_ends, lower=True)
        first = np.cumsum(counts) - counts
        pieces = np.where(counts > STRETCH, -(-(counts - STRETCH) // STEP) + 1, (counts > 0).astype(np.int64))
        self.paragraph = np.repeat(np.arange(len(counts)), pieces)
        number = np.arange(len(self.paragraph)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.start = first[self.paragraph] + STEP * number
        self.size = np.minimum(STRETCH, first[self.paragraph] + counts[self.paragraph] - self.start)
        owner = np.searchsorted(ends, line_ends, side="left")
        self.text = owner[self.paragraph]
        self.low, self.high = first[self.paragraph], first[self.paragraph] + counts[self.paragraph]
        self.paragraphs = np.bincount(owner[counts > 0], minlength=len(ends))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Feature of every word and of every pair of neighbours."""
        one = (self.h & np.uint64(FEATURES - 1)).astype(np.int64)
        two = (S.windows(self.h, 2) & np.uint64(FEATURES - 1)).astype(np.int64)
        return one, two

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of a stretch's features, over the root of their number."""
        one, two = self.features()
        a = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[one], axis=0, dtype=np.float64)])
        b = np.concatenate([np.zeros((1, weights.shape[1])), np.cumsum(weights[two], axis=0, dtype=np.float64)])
        end = self.start + self.size
        last = np.maximum(self.start, end - 1)
        total = a[end] - a[self.start] + b[np.minimum(last, len(b) - 1)] - b[np.minimum(self.start, len(b) - 1)]
        return total / np.sqrt(2 * self.size - 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Weights, classes and the calibrated limit; its size does not depend on the corpus."""

    def __init__(self, negatives: list[str], seed: int = SEED, variants: int = VARIANTS, false_alarms: float = FALSE_ALARMS):
        self.classes = sorted(TEMPLATES) + [PLAIN]
        rng = np.random.default_rng(seed)
        filler = " ".join(negatives).split() or ["text"]
        train, held = negatives[::2], negatives[1::2]
        texts, target = [], []
        for k, name in enumerate(self.classes[:-1]):
            for t in TEMPLATES[name]:
                for x in [t] + [vary(t, filler, rng) for _ in range(variants)]:
                    texts.append(x)
                    target.append(k)
        s = Stretches(pa.array(texts + [n.replace("\n", " ") for n in train], pa.string()))
        target = np.array(target + [len(self.classes) - 1] * len(train))[s.text]
        self.weights, self.bias = fit(s, target, len(self.classes))
        self.limit = 0.5
        if held:
            p = self.probabilities(Stretches(pa.array(held, pa.string())))
            if len(p):
                self.limit = float(max(0.3, np.quantile(1 - p[:, -1], 1 - false_alarms)))
        self.templates = {n: [pairs(Stretches(pa.array([t])).h) for t in TEMPLATES[n]] for n in self.classes[:-1]}

    def probabilities(self, s: Stretches) -> np.ndarray:
        return softmax(s.sums(self.weights) + self.bias) if len(s.start) else np.zeros((0, len(self.classes)))

    def compared(self, h: np.ndarray) -> dict[str, float]:
        """For each class, the share of its best template's words and word pairs that the stretch has."""
        own = pairs(h)
        return {n: max(len(t & own) / len(t) for t in ts) for n, ts in self.templates.items()}

    def scan(self, texts: pa.Array) -> list[tuple[int, list[str], int]]:
        """For each text: paragraphs, families of its confirmed paragraphs, and the number of unknown ones."""
        s = Stretches(texts)
        p = self.probabilities(s)
        families, unknown = [{} for _ in range(len(texts))], [set() for _ in range(len(texts))]
        for i in np.flatnonzero(1 - p[:, -1] > self.limit):
            shares = self.compared(s.h[max(s.low[i], s.start[i] - AROUND):min(s.high[i], s.start[i] + s.size[i] + AROUND)])
            found = {n: x for n, x in shares.items() if x >= CONFIRM and n != "unknown"}
            if found:  # among the families that the templates confirm, the likeliest one
                name = max(found, key=lambda n: (found[n], p[i, self.classes.index(n)]))
                families[s.text[i]][s.paragraph[i]] = name
            elif max(shares.values()) >= RELATED:
                unknown[s.text[i]].add(s.paragraph[i])
        return [(int(n), sorted(f.values()), len(u - set(f))) for n, f, u in zip(s.paragraphs, families, unknown)]


def pairs(h: np.ndarray) -> set[int]:
    return set(h.tolist()) | set(S.windows(h, 2).tolist())


def vary(text: str, filler: list[str], rng, around: int = 4) -> str:
    """A template with words left out or put in, and up to ``around`` other words on either side."""
    words = [w for w in text.split() if rng.random() > 0.08]
    for _ in range(rng.integers(0, 3)):
        words.insert(int(rng.integers(0, len(words) + 1)), filler[int(rng.integers(len(filler)))])
    some = lambda: [filler[int(i)] for i in rng.integers(0, len(filler), size=int(rng.integers(0, around + 1)))]
    return " ".join(some() + words + some())


def fit(s: Stretches, target: np.ndarray, classes: int, rounds: int = 120, rate: float = 0.5, ridge: float = 1e-4):
    """Softmax regression on sparse features by Adagrad; every class counts the same in total."""
    one, two = s.features()
    rows, cols = [], []
    for i, (a, n) in enumerate(zip(s.start, s.size)):
        f = np.concatenate([one[a:a + n], two[a:a + n - 1]])
        rows.append(np.full(len(f), i))
        cols.append(f)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    scale = (1 / np.sqrt(2 * s.size - 1))[rows][:, None]
    share = (1 / np.bincount(target, minlength=classes).clip(1))[target]
    share = (share / share.sum())[:, None]
    used, at = np.unique(cols, return_inverse=True)
    order = np.argsort(at, kind="stable")
    by_col = np.searchsorted(at[order], np.arange(len(used)))
    by_row = np.searchsorted(rows, np.arange(len(s.start)))
    truth = np.eye(classes)[target]
    w, b = np.zeros((len(used), classes)), np.zeros(classes)
    gw, gb = np.full(w.shape, 1e-8), np.full(classes, 1e-8)
    for _ in range(rounds):
        z = np.add.reduceat(w[at] * scale, by_row, axis=0) + b
        d = (softmax(z) - truth) * share
        g = np.add.reduceat((d[rows] * scale)[order], by_col, axis=0) + ridge * w / len(used)
        gw += g * g
        w -= rate * g / np.sqrt(gw)
        h = d.sum(axis=0)
        gb += h * h
        b -= rate * h / np.sqrt(gb)
    weights = np.zeros((FEATURES, classes), dtype=np.float32)
    weights[used] = w
    return weights, b


def train(docs: DataFrame, negatives: int = NEGATIVES) -> Model:
    line = docs.where("text is not null").select(F.explode(F.split("text", "\n")).alias("x")).where(
        (F.trim("x") != "") & ~F.col("x").rlike(CUES))
    plain = line.select("x", F.xxhash64("x").alias("h")).orderBy("h", "x").limit(negatives)
    return Model([r["x"] for r in plain.collect()])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_paragraphs, n_licenses, families, n_unknown``: ``families`` names each confirmed family once, in order."""
    def run(batches):
        for b in batches:
            _, ends = S.flat(b["text"])
            out, at = [], 0
            while at < len(b):  # stretches of text bound the memory
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                out += model.scan(b["text"].slice(at, to - at))
                at = to
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([o[0] for o in out], pa.int64()), pa.array([len(o[1]) for o in out], pa.int64()),
                 pa.array([",".join(sorted(set(o[1]))) for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())],
                names=["doc_id", "n_paragraphs", "n_licenses", "families", "n_unknown"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_paragraphs long, n_licenses long, families string, n_unknown long")


@register("op2_license_scan")
def op2_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
