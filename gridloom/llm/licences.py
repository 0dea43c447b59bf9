"""Licence paragraphs: n-gram logistic regression with a calibrated unknown class, confirmed by templates."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Paragraphs of the corpus, about, that stand for the unknown class in a fit, and variants made of each template.
FIT_PARAGRAPHS, VARIANTS = 3000, 24
FEATURES, ROUNDS = 1 << 15, 120
#: Share of a template's word pairs that a paragraph must have.
CONFIRM = 0.6
_WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_BROKEN = re.compile(r"[^\W_]-\s*$")

#: Notices of the licence families, in their usual wording.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache License 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "Distributed under the terms of the MIT license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL version 2.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Licensed under the ISC License.",
    ),
}


def tokens(paragraph: str) -> list[str]:
    return _WORDS.findall(paragraph.lower())


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


_FORMS = {family: [pairs(tokens(t)) for t in templates] for family, templates in TEMPLATES.items()}
_ANY_PAIR = frozenset(p for forms in _FORMS.values() for form in forms for p in form)


def features(words: list[str]) -> np.ndarray:
    """Hashed places of the distinct words and word pairs."""
    names = set(words) | {f"{a} {b}" for a, b in pairs(words)}
    return np.unique(np.asarray([zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names] or [0], np.int64))


def template_share(words: list[str], family: str) -> float:
    """Highest share of a template's word pairs that the words hold."""
    own = pairs(words)
    return max((len(own & form) / len(form) for form in _FORMS.get(family, ()) if form), default=0.0)


def _variants(template: str, rng: random.Random, n: int) -> list[list[str]]:
    """The template's words as they appear in the wild: some left out, some around it."""
    words, out = tokens(template), [tokens(template)]
    around = "copyright c 2019 2021 2024 the authors contributors see file for details all rights reserved this project code is note".split()
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.08] or words
        out.append([*rng.sample(around, rng.randrange(4)), *kept, *rng.sample(around, rng.randrange(4))])
    return out


class Classifier:
    """Softmax regression over hashed n-grams, with a temperature and the least probability of a family."""

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.5) -> None:
        self.families, self.weights, self.bias, self.temperature, self.least = families, weights, bias, temperature, least

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.asarray([self.weights[r].sum(axis=0) / np.sqrt(len(r)) for r in rows]) + self.bias

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        x = self.logits(rows) / self.temperature
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def predict(self, words: list[str]) -> tuple[str, float, float]:
        """(family or unknown, probability, template share) of one paragraph."""
        p = self.probabilities([features(words)])[0]
        best = int(np.argmax(p))
        family = self.families[best]
        if family == UNKNOWN or p[best] < self.least:
            return UNKNOWN, float(p[self.families.index(UNKNOWN)]), 0.0
        share = template_share(words, family)
        return (family if share >= CONFIRM else UNKNOWN), float(p[best]), share


def _train(rows: list[np.ndarray], labels: np.ndarray, families: list[str]) -> Classifier:
    """Gradient descent with momentum on the mean cross entropy, classes weighted alike."""
    k = len(families)
    flat, starts = np.concatenate(rows), np.cumsum([0, *(len(r) for r in rows[:-1])])
    owner, scale = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), 1 / np.sqrt([len(r) for r in rows])
    weight = (len(labels) / k / np.maximum(np.bincount(labels, minlength=k), 1))[labels]
    target = np.eye(k)[labels]
    model = Classifier(families, np.zeros((FEATURES, k)), np.zeros(k))
    speed, bias_speed = np.zeros_like(model.weights), np.zeros(k)
    for _ in range(ROUNDS):
        x = np.add.reduceat(model.weights[flat], starts, axis=0) * scale[:, None] + model.bias
        p = np.exp(x - x.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target) * weight[:, None] / len(labels)
        gradient = np.zeros_like(model.weights)
        np.add.at(gradient, flat, (error * scale[:, None])[owner])
        speed = 0.9 * speed - 4.0 * (gradient + 1e-6 * model.weights)
        bias_speed = 0.9 * bias_speed - 4.0 * error.sum(axis=0)
        model.weights += speed
        model.bias += bias_speed
    return model


def fit(paragraphs: list[str], seed: int = 5) -> Classifier:
    """Classifier of the templates' variants against ``paragraphs`` (the unknown class).

    A quarter of the examples is held out: the temperature has the least log loss there, and the
    least probability of a family (0.5 to 0.7) aims to let one in 200 held-out unknown paragraphs through;
    templates have the last word.
    """
    rng = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    examples = [(v, k) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f] for v in _variants(t, rng, VARIANTS)]
    own = [tokens(p) for p in paragraphs]
    examples += [(w, len(TEMPLATES)) for w in own if w and not pairs(w) & _ANY_PAIR]
    examples += [(rng.sample(v, len(v))[: 1 + len(v) // 3], len(TEMPLATES)) for v, _ in examples[: len(TEMPLATES) * VARIANTS]]  # their words, out of order
    rng.shuffle(examples)
    rows, labels = [features(w) for w, _ in examples], np.asarray([k for _, k in examples])
    cut = len(rows) * 3 // 4
    model = _train(rows[:cut], labels[:cut], families)
    logits, truth = model.logits(rows[cut:]), labels[cut:]

    def loss(t: float) -> float:
        x = logits / t - (logits / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), truth]))

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    p = model.probabilities(rows[cut:])
    strangers = np.sort(p[truth == len(TEMPLATES), : len(TEMPLATES)].max(axis=1))
    if len(strangers):
        model.least = float(min(0.7, max(0.5, strangers[min(len(strangers) - 1, int(0.995 * len(strangers)))])))
    return model


def paragraphs_of(text: str | None) -> list[str]:
    """Non-blank lines."""
    return [p for p in text.splitlines() if p and not p.isspace()] if text else []


def joined(lines: list[tuple[list[str], bool]]) -> list[str]:
    """Words of lines (words, ends in a hyphen) in a row; a word broken at its hyphen is one word."""
    out: list[str] = []
    for k, (words, _) in enumerate(lines):
        if k and lines[k - 1][1] and out and words:
            out[-1] += f"-{words[0]}"
            words = words[1:]
        out += words
    return out


def best_form(words: list[str], family: str) -> set:
    """The template of the family, as word pairs, of which the words hold the highest share."""
    own = pairs(words)
    return max(_FORMS[family], key=lambda form: len(own & form) / max(1, len(form)))


def runs_of(lines: list[list[str]]) -> Iterator[tuple[int, int]]:
    """(first, last) of the stretches of two and more lines that a wrapped notice can fill.

    ``lines`` are the words of a text's lines in order.  Lines without words (blank, or comment
    marks alone) end a run; a run is given whole, and cut to its longest stretches of lines that
    each take part in a template's word pair, on the line or over its border.
    """
    a = 0
    while a < len(lines):
        if not lines[a]:
            a += 1
            continue
        b = a
        while b + 1 < len(lines) and lines[b + 1]:
            b += 1
        part = [not _ANY_PAIR.isdisjoint(zip(lines[k], lines[k][1:])) for k in range(a, b + 1)]
        for k in range(a, b):
            if (lines[k][-1], lines[k + 1][0]) in _ANY_PAIR:
                part[k - a] = part[k + 1 - a] = True
        found = {(a, b)} if any(part) and a < b else set()
        k = 0
        while k < len(part):
            end = k
            while end < len(part) and part[end]:
                end += 1
            if end - k > 1:
                found.add((a + k, a + end - 1))
            k = max(end, k + 1)
        yield from sorted(found)
        a = b + 1


def sample_paragraphs(docs: DataFrame, n: int = FIT_PARAGRAPHS) -> list[str]:
    """About ``n`` paragraphs, one each of the documents with the least hashes of their ids; long ones are cut for the fit."""
    total = docs.count()
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(13)), F.lit(1 << 30)) / float(1 << 30)
    line = F.element_at(F.split(F.coalesce("text", F.lit("")), "\n"), -1)
    rows = docs.where(place < min(1.0, n / max(1, total))).select(F.substring(line, 1, 600).alias("p"))
    return sorted(r.p for r in rows.limit(2 * n).collect() if r.p)


FOUND = "doc_id long, n_paragraphs long, n_licensed long, families string, paragraph long, score double, template_share double"


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """One row per document (doc_id, text): paragraphs, licence paragraphs, their families (sorted, comma-joined), and the surest of them.

    A paragraph is a non-blank line, and a run of lines up to the next line without words, so that
    wrapped notices are found.  It counts where the classifier is sure of a family and one of the
    family's templates confirms it; a run counts only if no line or run inside it has counted for
    that family, and its number is that of its first line.  A hit inside a run is dropped where all
    that it holds of its template belongs to the run's, of which the run holds more.  One that shares no word pair with any
    template cannot be confirmed and is not scored.  Documents without such paragraphs have an empty ``families`` and nulls after it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, found, best = paragraphs_of(text), [], (None, None, None)
                every = text.splitlines() if text else []
                lines = [(tokens(line), bool(_BROKEN.search(line))) for line in every]
                number = list(itertools.accumulate((bool(line) and not line.isspace() for line in every), initial=0))
                singles = [(k, k) for k, (words, _) in enumerate(lines) if not _ANY_PAIR.isdisjoint(zip(words, words[1:]))]
                runs = sorted(runs_of([words for words, _ in lines]), key=lambda r: r[1] - r[0]) if singles or len(lines) > 1 else []
                hits: list[tuple] = []
                for a, b in [*singles, *runs]:
                    words = joined(lines[a : b + 1])
                    family, score, share = shared.value.predict(words)
                    inside = [h for h in hits if a <= h[0] and h[1] <= b]
                    if family == UNKNOWN or any(h[2] == family for h in inside):
                        continue
                    form = best_form(words, family)
                    part = [h for h in inside if h[4] < share and h[5] <= form]
                    hits = [h for h in hits if h not in part]
                    held = pairs(words[:-1] if lines[b][1] else words) & form
                    hits.append((a, b, family, score, share, held))
                for a, _, family, score, share, _ in hits:
                    found.append(family)
                    best = max(best, (score, share, -number[a]), key=lambda b: b[0] or -1.0)
                rows.append((doc, len(own), len(found), ",".join(sorted(set(found))), None if best[2] is None else -best[2], best[0], best[1]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
