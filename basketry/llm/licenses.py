"""Licence families of paragraphs: a trained n-gram classifier, confirmed against templates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.storage import written
from basketry.llm.textblocks import ALNUM, Block, Words, blocks, mix

#: Short notices of licence families, as their projects publish them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "SPDX-License-Identifier: LicenseRef-Proprietary",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU Affero General Public License.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Released under the GNU Lesser General Public License.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License v2.1.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
}
UNKNOWN = "unknown"
BUCKETS = 1 << 16
#: Words of the windows that are judged beside whole lines; each begins half a window after the one before.
WINDOWS = (16, 64)


@dataclass
class Templates:
    """Word pairs of all templates: sorted distinct hashes, and the templates that hold each (``first[i]`` to ``first[i + 1]``)."""

    pairs: np.ndarray
    first: np.ndarray
    holder: np.ndarray
    sizes: np.ndarray
    family: np.ndarray  # of each template, its class

    @staticmethod
    def build(classes: list[str]) -> Templates:
        own = [(classes.index(family), np.unique(_lines([text])[0].grams(2)[1])) for family, texts in TEMPLATES.items() for text in texts]
        flat = np.concatenate([x for _, x in own])
        holder = np.repeat(np.arange(len(own)), [len(x) for _, x in own])
        order = np.argsort(flat, kind="stable")
        pairs, first = np.unique(flat[order], return_index=True)
        sizes = np.array([len(x) for _, x in own])
        return Templates(pairs, np.concatenate((first, [len(flat)])), holder[order], sizes, np.array([c for c, _ in own]))

    def compare(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How well each template fits the pairs ``own`` of a text: its share, and where its first and last pair are.

        The share counts the template's pairs that the text has, against those and
        the text's other pairs between the first and the last of them: what is
        missing lowers it, and so does what is put in between.
        """
        n = len(self.sizes)
        at = np.searchsorted(self.pairs, own)
        at[at == len(self.pairs)] = 0
        place = np.flatnonzero(self.pairs[at] == own)
        counts = self.first[at[place] + 1] - self.first[at[place]]
        pair = np.repeat(at[place], counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        template, where = self.holder[self.first[pair] + step], np.repeat(place, counts)
        begin, end = np.full(n, len(own)), np.full(n, -1)
        np.minimum.at(begin, template, where)
        np.maximum.at(end, template, where)
        shared = np.bincount(np.unique(template * np.int64(len(self.pairs)) + pair) // len(self.pairs), minlength=n)
        inside = np.bincount(template, minlength=n)
        extra = np.maximum(0, end - begin + 1 - inside)
        return shared / (self.sizes + extra), begin, end


@dataclass
class Classifier:
    """Multinomial logistic regression over hashed word 1- and 2-grams, with a temperature fitted on other lines of the corpus."""

    classes: list[str]  # the last is UNKNOWN
    weights: np.ndarray  # (BUCKETS + 1, classes); the last row is the bias
    temperature: float
    templates: Templates


@dataclass
class Units:
    """Stretches of words to judge: lines, and windows of paragraphs (lines between blank ones, read on across line breaks)."""

    words: Words
    begin: np.ndarray  # first word of each unit, in order of documents
    end: np.ndarray
    paragraph: np.ndarray  # of each word, its paragraph's number in its document
    per_doc: np.ndarray  # paragraphs of each document


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(change)
    return begin, np.append(begin[1:], len(change))


def _units(block: Block, windows: tuple[int, ...] = WINDOWS) -> Units:
    words = Words(block, ALNUM, lower=True)
    n = len(words.hashes)
    if not n:
        none = np.zeros(0, np.int64)
        return Units(words, none, none, none, np.zeros(block.n, np.int64))
    line = np.searchsorted(np.flatnonzero(block.data == 0x0A), words.starts)
    new_doc = np.concatenate(([True], words.doc[1:] != words.doc[:-1]))
    new_line = new_doc | np.concatenate(([True], line[1:] != line[:-1]))
    new_paragraph = new_doc | np.concatenate(([True], line[1:] - line[:-1] > 1))
    number = np.cumsum(new_paragraph) - 1
    paragraph = number - number[words.first[words.doc]]
    begins, ends = [], []
    a, b = _runs(new_line)
    begins.append(a)
    ends.append(b)
    a, b = _runs(new_paragraph)
    several = np.add.reduceat(new_line, a) > 1
    for size in windows:
        some = (b - a > size) | (several & (size == windows[-1]))
        own_a, own_b, step = a[some], b[some], size // 2
        k = np.maximum(0, -(-(own_b - own_a - size) // step)) + 1
        turn = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        start = np.repeat(own_a, k) + turn * step
        begins.append(start)
        ends.append(np.minimum(np.repeat(own_b, k), start + size))
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin, kind="stable")
    per_doc = np.bincount(words.doc[a], minlength=block.n)
    return Units(words, begin[order], end[order], paragraph, per_doc)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the lines, and the line of each."""
    at, two = words.grams(2)
    return np.concatenate((_bucket(words.hashes), _bucket(two))), np.concatenate((words.doc, words.doc[at]))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _lines(texts: list[str]) -> tuple[Words, int]:
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t.replace("\n", " ") for t in texts], pa.string())})
    block = next(blocks([batch], size=1 << 40))
    return Words(block, ALNUM, lower=True), block.n


def _scores(weights: np.ndarray, buckets: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """Class scores of each line: the mean of its features' weights, times the root of their number, and the bias."""
    size = np.maximum(1, np.bincount(line, minlength=n))
    out = np.stack([np.bincount(line, weights[buckets, c], minlength=n) for c in range(weights.shape[1])], axis=1)
    return out / np.sqrt(size)[:, None] + weights[-1]


def _unit_scores(weights: np.ndarray, units: Units) -> np.ndarray:
    """The same for units, from sums along the words."""
    words, classes = units.words, weights.shape[1]
    at, two = words.grams(2)
    one, pair = (np.zeros((len(words.hashes) + 1, classes)) for _ in range(2))
    one[1:] = weights[_bucket(words.hashes)]
    pair[at + 1] = weights[_bucket(two)]
    np.cumsum(one, axis=0, out=one)
    np.cumsum(pair, axis=0, out=pair)
    n = units.end - units.begin
    return (one[units.end] - one[units.begin] + pair[units.end - 1] - pair[units.begin]) / np.sqrt(2 * n - 1)[:, None] + weights[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _variants(rng: np.random.Generator, others: list[str]) -> list[tuple[str, str]]:
    """Labelled paragraphs from the templates: whole, with words lost, and with words of other paragraphs around."""
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            for turn in range(40):
                own = [w for w in words if turn < 8 or rng.random() > 0.1]
                if turn >= 20 and others:
                    extra = others[int(rng.integers(len(others)))].split()[: int(rng.integers(1, 6))]
                    own = extra + own if turn % 2 else own + extra
                out.append((" ".join(own), family))
    return out


def fit(others: list[str], known: list[tuple[str, str]] = (), seed: int = 0, steps: int = 150, rate: float = 4.0) -> Classifier:
    """Train on template variants against ``others``, lines of the corpus that match no template.

    A fifth of ``others`` is not trained on. The temperature is fitted on it together
    with ``known``, lines of the corpus with the family they state, so that the
    probabilities hold for the corpus; without ``known`` a fifth of the variants stands in.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    classes = [*sorted(TEMPLATES), UNKNOWN]
    place = {c: i for i, c in enumerate(classes)}
    held_out = [(t, UNKNOWN) for t in others[::5]] + list(known)
    others = [t for i, t in enumerate(others) if i % 5]
    rows = _variants(rng, others) + [(t, UNKNOWN) for t in others]
    # single licence words in ordinary prose are no licence
    vocabulary = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.split()})
    for _ in range(400):
        base = others[int(rng.integers(len(others)))].split() if others else []
        some = [vocabulary[int(i)] for i in rng.integers(len(vocabulary), size=2)]
        rows.append((" ".join(base[:10] + some + base[10:20]), UNKNOWN))
    order = rng.permutation(len(rows))
    if not known:
        held_out += [rows[i] for i in order[::5]]
        order = np.delete(order, np.s_[::5])
    rows = [rows[i] for i in order]
    words, n = _lines([t for t, _ in rows])
    y = np.array([place[c] for _, c in rows])
    buckets, line = _features(words)
    used, own = np.unique(buckets, return_inverse=True)  # buckets that no line has keep the weight 0
    by_line, by_bucket = np.argsort(line, kind="stable"), np.argsort(own, kind="stable")
    lines, line_first = np.unique(line[by_line], return_index=True)
    bucket_first = np.unique(own[by_bucket], return_index=True)[1]
    scale = (1 / np.sqrt(np.maximum(1, np.bincount(line, minlength=n)))).astype(np.float32)
    own, line = own[by_line], line[by_bucket]
    weights, bias = np.zeros((len(classes), len(used)), np.float32), np.zeros((len(classes), 1), np.float32)
    speed, bias_speed = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    share = np.bincount(y, minlength=len(classes)).astype(float)
    cost = (n / len(classes) / np.maximum(1, share))[y]
    target = np.eye(len(classes), dtype=np.float32)[y].T
    cost = (cost / n).astype(np.float32)
    for _ in range(steps):  # classes are rows here, so that sums run along memory
        score = np.zeros((len(classes), n), np.float32)
        score[:, lines] = np.add.reduceat(np.take(weights, own, axis=1), line_first, axis=1)
        error = (_softmax((score * scale + bias).T).T - target) * cost
        step = np.add.reduceat(np.take(error * scale, line, axis=1), bucket_first, axis=1) + 1e-6 * weights
        bias_step = error.sum(axis=1, keepdims=True)
        speed += step**2
        bias_speed += bias_step**2
        weights -= rate / 10 * step / np.sqrt(speed)
        bias -= rate / 10 * bias_step / np.sqrt(bias_speed)
    whole = np.zeros((BUCKETS + 1, len(classes)), np.float32)
    whole[used], whole[-1] = weights.T, bias[:, 0]
    words, n = _lines([t for t, _ in held_out])
    raw, y = _scores(whole, *_features(words), n), np.array([place[c] for _, c in held_out], np.int64)
    grid = np.geomspace(0.25, 8, 26)
    loss = [-np.log(np.maximum(1e-12, _softmax(raw / t)[np.arange(n), y])).mean() for t in grid]
    return Classifier(classes, whole, float(grid[int(np.argmin(loss))]), Templates.build(classes))


def _sampled(rate: float, known_rate: float):
    """Lines whose hash is under a share of all: ordinary ones (no template fits them by a third), and those that state a family nearly word by word."""
    limits = np.array([min(1.0, rate), min(1.0, known_rate)]) * 2.0**62

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = sorted(TEMPLATES)
        templates = Templates.build(classes)
        best: set[tuple[int, str | None, str]] = set()
        for block in blocks(batches):
            units = _units(block, ())
            if not len(units.begin):
                continue
            words = units.words
            at, two = words.grams(2)
            chained = np.zeros(len(words.hashes) + 1, np.uint64)
            chained[at + 1] = two
            np.cumsum(chained, out=chained)
            h = mix(words.hashes[units.begin] + chained[units.end - 1] - chained[units.begin]) >> np.uint64(2)
            pairs = np.zeros(len(words.hashes), np.uint64)
            pairs[at] = two
            for i in np.flatnonzero(h < limits.max()):
                a, b = int(units.begin[i]), int(units.end[i])
                shares = templates.compare(pairs[a : b - 1])[0]
                top = int(shares.argmax())
                family = classes[templates.family[top]] if shares[top] >= 0.9 else None
                if family is None and (shares[top] > 1 / 3 or h[i] >= limits[0]):
                    continue
                line = block.data[words.starts[a] : words.ends[b - 1]].tobytes().decode("utf-8", "replace")
                best.add((int(h[i]), family, line))
        rows = sorted(best, key=lambda x: (x[0], x[2]))
        columns = [pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "family", "line"])

    return run


def train(docs: DataFrame, sample: int = 3000, seed: int = 0) -> Classifier:
    """A classifier against ordinary lines of ``docs (text, ...)``, calibrated on lines of the corpus.

    ``sample`` bounds the ordinary lines and those that state a family: each a share
    of all lines, by their hashes, whole and without repeats. The shares come from
    the number of lines, so the choice depends neither on how the table is cut nor on
    the number of tasks. Null and empty texts have no lines; an empty table leaves
    the templates alone to train on.
    """
    lines = docs.agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1)).first()[0] or 1
    rows = docs.select("text").mapInArrow(_sampled(2 * sample / lines, 40 * sample / lines), "h long, family string, line string")
    rows = written(rows.dropDuplicates(["family", "line"]), "licence-lines")
    ordinary = rows.where("family is null").orderBy("h", "line").limit(sample).collect()
    known = rows.where("family is not null").orderBy("h", "line").limit(sample).collect()
    return fit([r.line for r in ordinary], [(r.line, r.family) for r in known], seed)


def _widened(units: Units, a: int, b: int, more: int = 8) -> tuple[int, int]:
    """Words ``a`` to ``b`` with up to ``more`` words of their paragraph on either side."""
    doc, paragraph = units.words.doc, units.paragraph
    same = (doc[a], paragraph[a])
    low, high = a, b
    while low > max(0, a - more) and (doc[low - 1], paragraph[low - 1]) == same:
        low -= 1
    while high < min(len(doc), b + more) and (doc[high], paragraph[high]) == same:
        high += 1
    return low, high


def _entries(model: Classifier, units: Units, least: float, cover: float) -> list[list[dict]]:
    """The predictions of each document, the best of those that overlap."""
    words, unknown = units.words, len(model.classes) - 1
    out: list[list[dict]] = [[] for _ in range(len(words.first) - 1)]
    if not len(units.begin):
        return out
    p = _softmax(_unit_scores(model.weights, units) / model.temperature)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    at, two = words.grams(2)
    pairs = np.zeros(len(words.hashes), np.uint64)
    pairs[at] = two
    found: list[list[tuple]] = [[] for _ in out]
    for i in np.flatnonzero((best != unknown) & (sure >= least)):
        a, b, c = int(units.begin[i]), int(units.end[i]), int(best[i])
        shares, begin, end = model.templates.compare(pairs[a : b - 1])
        own = np.where(model.templates.family == c, shares, -1)
        top = int(own.argmax())
        covered = float(max(0.0, own[top]))
        confirmed = covered >= cover and covered >= shares.max()
        span = (a + int(begin[top]), a + int(end[top]) + 2) if covered > 0 else (a, b)
        if confirmed:  # a window may cut off what makes it another family's notice
            wide = _widened(units, *span)
            confirmed = covered >= model.templates.compare(pairs[wide[0] : wide[1] - 1])[0][model.templates.family != c].max()
        found[words.doc[a]].append((not confirmed, -covered, -float(sure[i]), b - a, span, c))
    for doc, own in enumerate(found):
        taken: list[tuple[int, int]] = []
        for rank, covered, p_own, _, (a, b), c in sorted(own):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                at_word = a - int(words.first[doc])
                entry = {"paragraph": int(units.paragraph[a]), "begin": at_word, "end": at_word + b - a, "family": model.classes[c]}
                out[doc].append(entry | {"probability": -p_own, "template_share": -covered, "confirmed": not rank})
        out[doc].sort(key=lambda x: x["begin"])
    return out


def _found(model: Classifier, least: float, cover: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("paragraph", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability",
            pa.float64()), ("template_share", pa.float64()), ("confirmed", pa.bool_())
        kind = pa.list_(pa.struct(names))
        for block in blocks(batches, size=1 << 18):
            units = _units(block)
            columns = [block.arrow("doc_id"), pa.array(units.per_doc), pa.array(_entries(model, units, least, cover), kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_paragraphs", "found"])

    return run


def license_families(docs: DataFrame, model: Classifier, least: float = 0.6, cover: float = 0.6) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: ``doc_id, n_paragraphs, n_licenses, families, found``.

    Paragraphs are lines between lines without words. What is judged are single
    lines and, across line breaks, windows of 16 and 64 words of each paragraph, so
    notices that are wrapped, commented or inside long text count. A stretch whose
    likeliest class is a licence family, with a calibrated probability of ``least``
    or more, is a prediction; it is confirmed if one of the family's templates
    fits it by ``cover`` or more (see ``Templates.compare``) and no template of
    another family fits it, or it with the eight words around it, better: CC BY-NC
    is not CC BY. Of predictions that overlap
    the best counts. ``found`` lists them with their words, ``families`` (sorted) and
    ``n_licenses`` those confirmed; the unknown class is not listed. Null and empty
    texts have no paragraphs. Whole texts are read, however long. Other columns are
    not read; each row is judged by itself, also where doc_ids repeat or are null.
    """
    entry = "array<struct<paragraph:long,begin:long,end:long,family:string,probability:double,template_share:double,confirmed:boolean>>"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = own.mapInArrow(_found(model, least, cover), f"doc_id long, n_paragraphs long, found {entry}")
    sure = F.filter("found", lambda x: x["confirmed"])
    families = F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))
    return rows.select("doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_licenses"), families.alias("families"), "found")
