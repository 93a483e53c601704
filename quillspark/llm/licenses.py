"""License scans by a trained paragraph classifier.

Features are lower-case words and word pairs, hashed to ``SIZE`` columns; a multinomial logistic regression over them knows the
licence families of ``TEMPLATES``, ``unknown`` (licence language of no known family) and ``none``. It is fitted on the notices and on
short references made from ``NAMES`` and ``FORMS``, wrapped to lines, with words dropped, swapped and surrounded (a fixed seed), on
``NOTICES`` of no family, and on a bounded sample of the corpus's own lines as ``none`` (``SAMPLE`` documents with the smallest hash,
``LINES`` lines of each, drawn by hash from the whole text). A temperature fitted on held-out variants calibrates it; ``Model.error``
is its expected calibration error there.

Paragraphs end at blank lines. All lines are weighed at once, in arrays; lines that aren't ``none`` and follow each other in a
paragraph (one line between may be) are a licence passage, whose weights are the sum of its lines', so a notice is
judged as one wherever it is wrapped. A passage that the model gives to a family is compared with the templates of all families:
it is confirmed if ``CONFIRM`` of the word pairs of one of that family's templates (any number counts as the same word) stand in
it and no template of another family fits better; if another's does, that family is confirmed instead. A passage that no template
confirms is ``unknown``, given a probability of ``UNKNOWN`` or more of not being ``none``.

Scoring is one pass over whole texts. Nulls: a null or empty text has no paragraphs, and its family is ``none``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, mixed, prefix_hash, rows_of, table

SIZE, SAMPLE, LINES, CONFIRM, UNKNOWN, SEED = 1 << 16, 300, 20, 0.6, 0.9, 17
#: The notices by which works are put under each family's licences, one variant each.
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is published under CC0 1.0 Universal Public Domain Dedication."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: How short references name a licence.
NAMES = {
    "agpl": ["the GNU Affero General Public License, version 3", "AGPL-3.0"], "apache": ["the Apache License, Version 2.0", "Apache-2.0"],
    "bsd": ["the BSD 3-Clause License", "the BSD 2-Clause License", "BSD-3-Clause"], "cc": ["CC BY 4.0", "CC BY-NC 4.0", "CC BY-SA 4.0", "a Creative Commons Attribution licence"],
    "cc0": ["CC0 1.0 Universal", "CC0-1.0"], "gpl": ["the GNU General Public License, version 3", "GPL-3.0", "the GNU GPL v2"], "isc": ["the ISC License", "ISC"],
    "lgpl": ["the GNU Lesser General Public License, version 3", "LGPL-2.1"], "mit": ["the MIT License", "MIT"], "mpl": ["the Mozilla Public License, version 2.0", "MPL-2.0"], "unlicense": ["the Unlicense", "Unlicense"],
}
FORMS = ("Licensed under {}.", "Released under {}.", "Distributed under the terms of {}.", "This work is licensed under {}.", "This software is available under {}.", "License: {}", "SPDX-License-Identifier: {}")
#: Licence language of no family above.
NOTICES = [
    "All rights reserved. No part of this publication may be reproduced without permission.", "All rights reserved.", "Copyright by the author. Unauthorised copying is prohibited.",
    "This material is licensed under the terms of a private agreement.", "Use of this document is subject to the licence of the publisher.", "Proprietary and confidential. Licensed to the customer only.",
]
CLASSES = ["none", "unknown", *TEMPLATES]
_TOKEN = re.compile(r"[a-z]+|\d+")


def _words(line: str) -> list[str]:
    return ["0" if w.isdigit() else w for w in _TOKEN.findall(line.lower())]


def _pairs(line: str) -> set:
    w = _words(line)
    return set(zip(w, w[1:]))


def columns_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column of each feature, its line, number of lines) of UTF-8 text; words are split at white space, case folded."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~gap
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line_of = np.concatenate(([0], np.cumsum(data == 10)))[starts]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), starts
    sums, inverse = prefix_hash(data)
    word = mixed((sums[ends] - sums[starts]) * inverse[starts])
    pair = mixed(word[:-1] * np.uint64(3) + word[1:])
    same = line_of[:-1] == line_of[1:]
    mask = np.uint64(SIZE - 1)
    return np.concatenate((word & mask, pair[same] & mask)).astype(np.int64), np.concatenate((line_of, line_of[:-1][same])), starts


def _short(name: str) -> list[str]:
    return [f.format(name) for f in FORMS]


def _compared() -> list[tuple[str, set]]:
    """(family, word pairs) of all templates; of a short reference the name alone, with the word before it."""
    long = [(c, _pairs(t)) for c, texts in TEMPLATES.items() for t in texts]
    return long + [(c, _pairs(f"{lead} {n}")) for c, names in NAMES.items() for n in names for lead in ("under", "of", "License:", "License Identifier:")]


_COMPARED = _compared()


class Model:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float, error: float = 0.0):
        self.weights, self.bias, self.temperature, self.error = weights, bias, temperature, error

    def evidence(self, data: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
        """What the words of each line add to each class, and which lines have no words."""
        column, line, _ = columns_of(data)
        return np.stack([np.bincount(line, self.weights[c, column], lines) for c in range(len(CLASSES))], 1), np.bincount(line, minlength=lines) == 0

    def scan(self, text: bytes):
        """(number of paragraphs, [(first line, last line, family, probability, confirmed)] of the licence passages)."""
        data = np.frombuffer(text, np.uint8)
        n = int((data == 10).sum()) + 1
        z, blank = self.evidence(data, n)
        count = int(np.count_nonzero(~blank & np.concatenate(([True], blank[:-1]))))
        likely = np.flatnonzero((z + self.bias).argmax(axis=1))
        if not len(likely):
            return count, []
        lines, paragraph, out = text.split(b"\n"), np.cumsum(blank), []
        for own in np.split(likely, np.flatnonzero((np.diff(likely) > 2) | (np.diff(paragraph[likely]) > 0)) + 1):
            a, b = int(own[0]), int(own[-1])
            logits = (z[a : b + 1].sum(axis=0) + self.bias) / self.temperature
            p = np.exp(logits - logits.max())
            p /= p.sum()
            pairs = _pairs(b" ".join(lines[a : b + 1]).decode("utf-8", "replace"))
            fits = sorted(((len(pairs & t) / len(t), len(t), c) for c, t in _COMPARED), reverse=True)
            # of templates that fit well enough the one with most pairs in the passage says most
            sure = max(((x * k, c) for x, k, c in fits if x >= CONFIRM), default=None)
            if sure:
                out.append((a, b, sure[1], float(p[CLASSES.index(sure[1])]), True))
            elif 1 - p[0] >= UNKNOWN:
                out.append((a, b, "unknown", float(1 - p[0]), False))
        return count, out


def _variants(text: str, count: int, filler: list[str], rng) -> list[str]:
    out = [text, text.lower(), text.upper()]
    while len(out) < count:
        words = text.split()
        if len(words) > 12 and rng.random() < 0.7:  # a line of a wrapped notice
            width = int(rng.integers(6, 14))
            at = int(rng.integers(0, len(words) - 5))
            words = words[at : at + width]
        words = [w for w in words if rng.random() > 0.06] or words
        if rng.random() < 0.3:
            words = [filler[k] for k in rng.integers(0, len(filler), rng.integers(1, 6))] + words
        if rng.random() < 0.3:
            words += [filler[k] for k in rng.integers(0, len(filler), rng.integers(1, 6))]
        out.append(" ".join(str(rng.integers(1, 9)) + ".0" if re.search(r"\d", w) and rng.random() < 0.5 else w for w in words))
    return out


def fit_lines(corpus: list[str]) -> Model:
    """The model, with these lines of the corpus as ``none``."""
    rng = np.random.default_rng(SEED)
    known = [t for _, t in _COMPARED]
    plain = [x for x in corpus if x.strip() and not any(len(own & t) >= 0.3 * len(t) for own in [_pairs(x)] for t in known)]
    plain += ["the work is done", "this is a line of text", "a version of the file", "see the terms of the story", "released in the summer", "0 1 2", "the software is free", "a copy of the book"]
    filler = [w for x in plain for w in x.split()]
    examples = [("none", x) for x in plain]
    examples += [("unknown", v) for x in NOTICES for v in _variants(x, 60, filler, rng)]
    examples += [(c, v) for c, texts in TEMPLATES.items() for t in texts for v in _variants(t, 80, filler, rng)]
    examples += [(c, v) for c, names in NAMES.items() for name in names for t in _short(name) for v in _variants(t, 8, filler, rng)]
    order = rng.permutation(len(examples))
    fit, check = order[: len(order) * 4 // 5], order[len(order) * 4 // 5 :]

    def matrix(which):
        cols = [np.unique(columns_of(np.frombuffer(examples[k][1].replace("\n", " ").encode(), np.uint8))[0]) for k in which]
        return np.repeat(np.arange(len(cols)), [len(c) for c in cols]), np.concatenate(cols), np.array([CLASSES.index(examples[k][0]) for k in which])

    row, col, y = matrix(fit)
    used, place = np.unique(col, return_inverse=True)
    weights, bias, truth = np.zeros((len(CLASSES), len(used))), np.zeros(len(CLASSES)), np.eye(len(CLASSES))[y]
    share = np.maximum(truth.sum(axis=0), 1)
    heft = (len(y) / len(CLASSES) / share)[y][:, None] ** 0.5
    for _ in range(80):
        z = np.stack([np.bincount(row, weights[c, place], len(y)) for c in range(len(CLASSES))], 1) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        grad = heft * (p / p.sum(axis=1, keepdims=True) - truth)
        for c in range(len(CLASSES)):
            weights[c] -= 4.0 / len(y) ** 0.5 * np.bincount(place, grad[row, c], len(used)) / 4 + 1e-4 * weights[c]
        bias -= grad.mean(axis=0)
    whole = np.zeros((len(CLASSES), SIZE))
    whole[:, used] = weights
    row, col, y = matrix(check)
    z = np.stack([np.bincount(row, whole[c, col], len(y)) for c in range(len(CLASSES))], 1) + bias

    def chances(t):
        s = np.exp((z - z.max(1, keepdims=True)) / t)
        return s / s.sum(1, keepdims=True)

    def loss(t):
        return float(-np.log(np.maximum(chances(t)[np.arange(len(y)), y], 1e-12)).mean())

    best = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0), key=loss)
    top, right = chances(best).max(axis=1), chances(best).argmax(axis=1) == y
    bins = np.minimum((top * 10).astype(int), 9)
    error = sum(abs(top[bins == k].mean() - right[bins == k].mean()) * (bins == k).mean() for k in np.unique(bins))
    return Model(whole, bias, best, float(error))


def fit(docs: DataFrame) -> Model:
    docs = documents(docs).where("text is not null")
    # ids alone are sorted and broadcast, SAMPLE of them; only the chosen documents' lines leave their tasks
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    drawn = F.transform(F.split("text", "\n"), lambda line, k: F.struct(F.xxhash64("doc_id", k), line.alias("line")))
    lines = F.transform(F.slice(F.array_sort(drawn), 1, LINES), lambda x: F.substring(x["line"], 1, 1 << 12))
    return fit_lines(sorted(x for r in docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(lines).collect() for x in r[0]))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, family (of the surest licence paragraph; none without one), probability, confirmed, n_paragraphs, n_licensed (passages), lines (the first
    of each passage)."""
    docs = documents(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in rows_of(batch):
                n, found = sent.value.scan(text) if text else (0, [])
                best = max(found, key=lambda x: (x[4], x[3], -x[0]), default=(0, 0, "none", 1.0, False))
                out.append((doc_id, best[2], best[3], best[4], n, len(found), [x[0] for x in found]))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            names = ("doc_id", "family", "probability", "confirmed", "n_paragraphs", "n_licensed", "lines")
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return docs.mapInArrow(run, "doc_id long, family string, probability double, confirmed boolean, n_paragraphs int, n_licensed int, lines array<int>")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op9_licenses": op9_licenses}, {}
