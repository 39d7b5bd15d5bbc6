"""License notices in texts: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text's words are lowered and stripped of punctuation; its shingles are five words, or all words of a template that has
fewer. Templates are taken in classes by the power of two m that their size n does not exceed; for each class the text is
cut into windows of 2m shingles, m apart, so that every stretch of m shingles lies within one window. Window minima are
made from minima of m-shingle pieces, and those from the smaller class's, so each hash goes over a text once. A window that agrees with a template in all rows of one of the class's
bands is a candidate. A window that holds at least ``CONTAINED`` of a template of n shingles has a Jaccard similarity
with it of at least ``least_similarity(n, m)``; ``bands_for`` takes as many bands as miss the least similarity of the
class with chance under ``MISS``. A candidate is verified on its window widened by m to both sides, as words put into a
notice stretch it: it counts if the shingles there hold at least CONTAINED of the template's set.

One pass without a shuffle; a task holds one batch of texts, and the templates, which are a parameter of bounded size.
Defined results: null and empty texts have no notice; a null id is kept; equal rows give equal rows; of a template found
in several windows of a text the one with the most of it, then the first, is given; first_word and n_words are of the
stretch from the first to the last of its shingles there; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED, MISS, ROWS = 5, 0.8, 1e-6, 1
# Notices by which texts name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "All-rights-reserved": "All rights reserved.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "Apache-2.0-notice": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
EDGE = ".,;:!?\"'()[]{}<>*#"
RESULT = "doc_id long, license string, containment double, first_word long, n_words long"
_P = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for x in text.lower().split() if (w := x.strip(EDGE))], np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = (total ^ words[k : k + n]) * _P
        total ^= total >> np.uint64(29)
    return total


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """So many bands of so many rows that a pair of this similarity agrees in none with chance under miss."""
    return int(np.ceil(np.log(miss) / np.log1p(-(similarity**rows))))


def least_similarity(n: int, m: int) -> float:
    """Of a window of 2m shingles that holds CONTAINED of a template of n."""
    return CONTAINED * n / (2 * m + n - CONTAINED * n)


class Library:
    """Templates by class (shingle length, m) with their sets and the values of their bands.

    A template of one shingle needs no overlap and one band: its window is one shingle, equal or not.
    """

    def __init__(self, templates: dict[str, str]) -> None:
        rng, sets = np.random.default_rng(11), []
        for name, text in templates.items():
            words = word_hashes(text)
            if len(words):
                size = min(SHINGLE, len(words))
                sets.append((size, len(own := np.unique(shingle_hashes(words, size))), name, own))
        self.classes: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for size, n, name, own in sorted(sets, key=lambda x: x[:3]):
            self.classes.setdefault((size, 1 << (n - 1).bit_length()), []).append((name, own))
        self.bands = {(size, m): 1 if m == 1 else bands_for(min(least_similarity(len(s), m) for _, s in own)) for (size, m), own in self.classes.items()}
        most = max(self.bands.values(), default=1) * ROWS
        self.a = rng.integers(0, 2**31, most, dtype=np.uint32) << np.uint32(1) | np.uint32(1)
        self.values = {}
        for k, own in self.classes.items():
            values = np.array([self.minima(s, self.bands[k]).min(1) for _, s in own])
            quick = np.zeros((values.shape[1], 65536), bool)  # by band and the value's last bits
            quick[np.arange(values.shape[1])[None, :], values & np.uint32(65535)] = True
            self.values[k] = (values, quick.reshape(-1), (np.arange(values.shape[1], dtype=np.uint32) << np.uint32(16))[:, None])

    def minima(self, shingles: np.ndarray, functions: int) -> np.ndarray:
        """functions x shingles"""
        x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :] * self.a[:functions, None]
        return x ^ (x >> np.uint32(15))

    def find(self, text: str) -> dict[str, tuple[float, int, int]]:
        """name -> (containment, first word, words)"""
        out: dict[str, tuple[float, int, int]] = {}
        words, before, last = word_hashes(text), (0, 0, None), 0  # before: shingle length, m and minima of the last pieces
        for (size, m), own in self.classes.items():
            if size != last:
                s, last = shingle_hashes(words, size), size
            if not len(s):
                continue
            (values, quick, bands), functions = self.values[size, m], self.bands[size, m]
            if m == 1:
                windows = self.minima(s, 1)
            else:
                if before[0] == size:
                    pieces = np.minimum.reduceat(before[2], np.arange(0, before[2].shape[1], m // before[1]), axis=1)
                else:  # a run of whole pieces at a time
                    run = m * max(1, 4096 // m)
                    pieces = np.concatenate([np.minimum.reduceat(h := self.minima(s[i : i + run], len(self.a)), np.arange(0, h.shape[1], m), axis=1) for i in range(0, len(s), run)], 1)
                before, pieces = (size, m, pieces), pieces[:functions]
                windows = np.minimum(pieces, np.concatenate((pieces[:, 1:], pieces[:, -1:]), 1))
            for w in np.flatnonzero(quick[windows & np.uint32(65535) | bands].any(0)).tolist():  # a band is one row
                low, high = (max(0, (w - 1) * m), (w + 3) * m) if m > 1 else (w, w + 1)
                part = s[low:high]
                for t in np.flatnonzero((values == windows[:, w][None, :]).any(1)).tolist():
                    name, full = own[t]
                    share = float(np.isin(full, part).sum()) / len(full)
                    if share >= CONTAINED and share > out.get(name, (0.0,))[0]:
                        at = np.flatnonzero(np.isin(part, full))
                        out[name] = (share, low + int(at[0]), int(at[-1] - at[0]) + size)
        return out


def templates_of(table: DataFrame, name: str = "name", text: str = "text", most_bytes: int = 64 << 20) -> dict[str, str]:
    """Templates of a table, as full licence texts are kept; it is an error if they have more than most_bytes."""
    rows = table.where(F.col(name).isNotNull() & F.col(text).isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates, more than {most_bytes}")
    return {r[0]: r[1] for r in rows.select(name, text).orderBy(name, text).collect()}


_libraries: dict[int, Library] = {}


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """RESULT: a row for each text and template found in it."""
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(templates.items())))
        if key not in _libraries:
            _libraries[key] = Library(templates)
        for batch in batches:
            out = [(i, name, *found) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for name, found in sorted(_libraries[key].find(t).items())]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], names=[f.split()[0] for f in RESULT.split(", ")])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, RESULT)
