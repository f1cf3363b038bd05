"""Licence scans by a trained paragraph classifier.

A paragraph is a line. Its features are the word n-grams (one to three words) that occur in any template, and the share of
its words that occur in none. A softmax regression over the families and an unknown class is trained on templates, with
words dropped, cut and mixed with the corpus' own, against paragraphs of the corpus; its temperature is set on a held-out
half. A prediction counts only when the family's nearest template confirms it: enough of the template's three-word
n-grams stand in the paragraph.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import BASE, lowered, mixed, prefix_hash, runs, slices, spans_hash, text_bytes

#: Families and notices as their licences word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
UNKNOWN = "unknown"
#: Paragraphs of the corpus that stand for the unknown class in training, the first in an order by hash.
SAMPLE = 4000
VARIANTS, ROUNDS, RATE, SHRINK = 60, 400, 1.0, 1e-4
#: Least calibrated probability, and least share of a template's n-grams.
LEAST, CONFIRM = 0.8, 0.6


@dataclass(frozen=True)
class Model:
    """families[0] is unknown; weights has a row for each code, one for the share of other words, one for the bias."""
    families: tuple
    codes: np.ndarray
    weights: np.ndarray
    temperature: float
    templates: tuple


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Codes, sizes and paragraphs of all n-grams, byte spans of the paragraphs that have words, and their texts."""
    low = lowered(data)
    solid = (data >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    starts, ends, doc = runs(solid, offsets)
    one = spans_hash(prefix_hash(low), starts, ends)
    line = np.cumsum(data == 10)[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    part = np.cumsum(new) - 1
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)[:int(new.sum())]
    codes, where, sizes, gram = [one], [part], [np.ones(len(one), np.int8)], one
    for n in (2, 3):
        gram = mixed(gram[:-1] * np.uint64(BASE) + one[n - 1:]) if len(gram) else gram
        whole = part[:len(gram)] == part[n - 1:] if len(gram) else np.zeros(0, bool)
        codes.append(gram[whole]), where.append(part[:len(gram)][whole]), sizes.append(np.full(int(whole.sum()), n, np.int8))
    return np.concatenate(codes), np.concatenate(where), np.concatenate(sizes), starts[new], ends[last], doc[new]


def _of_texts(texts: list[str]):
    return _grams(*text_bytes(pa.array([t.replace("\n", " ") for t in texts], pa.string())))


def _template_codes(size: int) -> list[np.ndarray]:
    return [np.unique(c[z == size]) for c, _, z, *_ in (_of_texts([t]) for _, t in TEMPLATES)]


def _hits(codes, where, sizes, known, parts):
    """Paragraph and feature of each known n-gram, once for each, and the share of words that no template has."""
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    mine = known[at] == codes
    pairs = np.unique(where[mine] * len(known) + at[mine])
    alone = sizes == 1
    other = np.bincount(where[alone & ~mine], minlength=parts) / np.maximum(1, np.bincount(where[alone], minlength=parts))
    return pairs // len(known), pairs % len(known), other


def _logits(weights, where, feature, other):
    z = np.outer(other, weights[-2]) + weights[-1]
    for k in range(weights.shape[1]):
        z[:, k] += np.bincount(where, weights=weights[feature, k], minlength=len(other))
    return z


def _softmax(z):
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The classifier; of the corpus it reads at most `sample` paragraphs without a template's three-word n-gram."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    lines = [r.line for r in lines.orderBy(F.xxhash64("line"), "line").limit(sample).collect()]
    families = (UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES))
    trigrams = _template_codes(3)
    known = np.unique(np.concatenate([np.unique(_of_texts([t])[0]) for _, t in TEMPLATES]))
    pick = np.random.default_rng(7)
    fillers = " ".join(lines[:200]).split() or ["word"]
    texts, labels = [], []
    for family, text in TEMPLATES:
        for k in range(VARIANTS):
            w = [x for x in text.split() if k < 5 or pick.random() > 0.15]
            for _ in range(pick.integers(0, 12) if k >= 5 else 0):
                w.insert(pick.choice([0, len(w)]), fillers[pick.integers(len(fillers))])
            texts.append(" ".join(w)), labels.append(families.index(family))
    every = np.unique(np.concatenate(trigrams))
    codes, where, _, _, _, owner = _of_texts(lines)
    marked = set(owner[where[np.isin(codes, every)]].tolist())
    clean = [t for i, t in enumerate(lines) if i not in marked]
    texts, labels = texts + clean, np.array(labels + [0] * len(clean))
    codes, where, sizes, starts, _, owner = _of_texts(texts)
    row, feature, other = _hits(codes, where, sizes, known, len(starts))
    x = np.zeros((len(starts), len(known) + 2), np.float32)
    x[row, feature] = 1
    x[:, -2], x[:, -1] = other, 1
    y = np.eye(len(families), dtype=np.float32)[labels[owner]]
    fit = np.arange(len(y)) % 2 == 0
    weights = np.zeros((x.shape[1], len(families)), np.float32)
    balance = (1 / np.maximum(1, y[fit].sum(axis=0)))[y[fit].argmax(axis=1)][:, None] * np.float32(1 / len(families))
    speed = np.zeros_like(weights)
    for _ in range(ROUNDS):
        speed = 0.9 * speed + x[fit].T @ (balance * (_softmax(x[fit] @ weights) - y[fit])) + SHRINK * weights
        weights = weights - RATE * speed

    def loss(t):
        return -np.log(np.maximum((_softmax(x[~fit] @ weights / t) * y[~fit]).sum(axis=1), 1e-9)).mean()

    return Model(families, known, weights.astype(np.float64), float(min((0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)), tuple(zip((f for f, _ in TEMPLATES), trigrams)))


def _scan(model: Model):
    every = np.unique(np.concatenate([c for _, c in model.templates]))
    kind = pa.list_(pa.struct([("family", pa.string()), ("p", pa.float64()), ("similarity", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column(1))
                codes, where, sizes, starts, ends, owner = _grams(data, offsets)
                found: list[list] = [[] for _ in range(part.num_rows)]
                if len(starts):
                    row, feature, other = _hits(codes, where, sizes, model.codes, len(starts))
                    p = _softmax(_logits(model.weights, row, feature, other) / model.temperature)
                    best = p.argmax(axis=1)
                    likely = np.flatnonzero((best > 0) & (p[np.arange(len(best)), best] >= LEAST))
                    mine = np.isin(where, likely) & (sizes == 3)
                    mine[mine] = np.isin(codes[mine], every)
                    of = {k: set() for k in likely.tolist()}
                    for k, c in zip(where[mine].tolist(), codes[mine].tolist()):
                        of[k].add(c)
                    for k in likely.tolist():
                        family = model.families[best[k]]
                        similarity = max(len(of[k].intersection(c.tolist())) / len(c) for f, c in model.templates if f == family)
                        if similarity >= CONFIRM:
                            base = offsets[owner[k]]
                            found[owner[k]].append({"family": family, "p": round(float(p[k, best[k]]), 6), "similarity": round(similarity, 6), "start": int(starts[k] - base), "end": int(ends[k] - base)})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["row", "notices"])
    return run


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, license (of the likeliest confirmed notice, null without one), confidence,
    similarity, n_notices, notices (family, p, similarity, start and end in bytes).

    All lines of the whole texts are judged; null and empty texts have none. Lines with fewer than three words confirm
    nothing. Rows repeated are scanned each; other columns are not read.
    """
    rows = docs.select(F.struct("doc_id").alias("row"), "text")
    found = rows.mapInArrow(_scan(model or train(docs)), f"row {rows.schema['row'].dataType.simpleString()}, notices array<struct<family: string, p: double, similarity: double, start: bigint, end: bigint>>")
    best = F.element_at(F.array_sort("notices", lambda a, b: F.when(a["p"] != b["p"], F.signum(b["p"] - a["p"]).cast("int")).otherwise((a["start"] - b["start"]).cast("int"))), 1)
    found = found.withColumn("best", F.when(F.size("notices") > 0, best))
    return found.select("row.doc_id", F.col("best.family").alias("license"), F.col("best.p").alias("confidence"), "best.similarity", F.size("notices").cast("long").alias("n_notices"), "notices")
