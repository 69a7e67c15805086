"""License scans by MinHash over text windows.

Documents and templates are cut into overlapping windows of words. Bands of MinHash values look
up templates with windows alike; the settings find a window of a whole template with the
probability that ``miss_chance`` gives. What is found is verified: the share of the template's
shingles that the document holds near the place must reach the threshold exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberledger.llm.shared import add_columns
from emberledger.llm.tokens import NOT_ALPHANUMERIC, Texts, Words, mix, windows

#: Words of a shingle, share of a template's shingles that must be there, words between starts
#: of windows; a window is two steps long.
SHINGLE, CONTAINMENT, STEP = 3, 0.8, 6
BANDS, ROWS = 48, 1

#: Notices of common licenses, as projects state them. Fixed values.
TEMPLATES = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be "
                     "found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International "
                  "License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under "
                 "the terms of the GNU Lesser General Public License."),
)


def miss_chance(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Probability that two windows of that Jaccard similarity share no band."""
    return (1 - similarity ** rows) ** bands


def _shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Shingle keys, and each text's range of them; of fewer words, the whole text is one."""
    keys, ranges = words.keys, words.ranges
    out, counts = [], []
    whole = windows(keys, SHINGLE)
    for low, high in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        n = high - low
        part = (whole[low:high - SHINGLE + 1] if n >= SHINGLE
                else windows(keys[low:high], n, salt=n)[:1] if n else whole[:0])
        out.append(part)
        counts.append(len(part))
    return (np.concatenate(out) if out else whole[:0]), np.concatenate(([0], np.cumsum(counts)))


def _bands(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Band keys (window, band) of ranges of shingles, none of them empty."""
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    inside = shingles[np.repeat(starts - at, sizes) + np.arange(sizes.sum())]
    signature = np.zeros((len(starts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(starts), band, np.uint64)
            for row in range(ROWS):
                value = mix(inside ^ mix(np.array([1 + band * ROWS + row])))
                key = mix(key + np.minimum.reduceat(value, at))
            signature[:, band] = key
    return signature


class TemplateIndex:
    """Bands of the templates' windows, and their shingles for the exact check."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        rows = [(name, text) for name, text in templates if text]
        words = Words(Texts.of(pa.array([t for _, t in rows], pa.string())), NOT_ALPHANUMERIC,
                      lower=True)
        shingles, ranges = _shingles(words)
        self.names = [name for name, _ in rows]
        self.shingles = [np.unique(shingles[a:b]) for a, b in zip(ranges, ranges[1:],
                                                                   strict=False)]
        self.lengths = words.counts
        starts, ends, owner = _window_places(ranges, phases=True)
        keys = _bands(shingles, starts, ends).ravel() if len(starts) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], np.repeat(owner, BANDS)[order]
        self.vocabulary = np.unique(np.concatenate([*self.shingles, shingles[:0]]))


def _window_places(ranges: np.ndarray, phases: bool) -> tuple[np.ndarray, ...]:
    """(start, end, text) of windows of shingles in each text. With all phases a window begins at
    every shingle, so that one of them lies as a document's windows do."""
    starts, ends, owner = [], [], []
    step = 1 if phases else STEP
    for i, (low, high) in enumerate(zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True)):
        for at in range(low, max(low + 1, high - STEP + 1), step) if high > low else ():
            starts.append(at)
            ends.append(min(at + 2 * STEP, high))
            owner.append(i)
    return tuple(np.array(x, np.int64) for x in (starts, ends, owner))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
         text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """The rows with ``licenses``: an array of (license, containment, begin, stop), sorted by
    begin and name. ``containment`` is the share of a template's distinct shingles that the text
    holds in the words [begin, stop) around the place; overlapping finds of one license are one,
    the first of those with the highest share.

    The templates are given as (name, text), a few hundred at most; they are sent to each task.
    Null and empty texts hold nothing. Rows are judged one by one, so repeated rows get equal
    results; equal templates are each found. A column named ``licenses`` gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates))

    def make():
        index = shared.value

        def work(column):
            return [pa.array(_scan(column, index, containment), pa.list_(pa.struct([
                ("license", pa.string()), ("containment", pa.float64()),
                ("begin", pa.int64()), ("stop", pa.int64())])))]

        return work

    return add_columns(
        docs, text_col, "licenses array<struct<license string, containment double, begin long, "
        "stop long>>", make)


def _scan(column: pa.Array, index: TemplateIndex, containment: float) -> list[list[dict]]:
    words = Words(Texts.of(column), NOT_ALPHANUMERIC, lower=True)
    shingles, ranges = _shingles(words)
    found: list[list[dict]] = [[] for _ in range(len(words.texts))]
    if not len(shingles) or not len(index.vocabulary):
        return found
    # A band can only be shared by windows that hold a shingle of a template.
    at = np.minimum(np.searchsorted(index.vocabulary, shingles), len(index.vocabulary) - 1)
    known = np.concatenate(([0], np.cumsum(index.vocabulary[at] == shingles)))
    starts, ends, owner = _grid(ranges)
    some = known[ends] > known[starts]
    starts, ends, owner = starts[some], ends[some], owner[some]
    if not len(starts):
        return found
    keys = _bands(shingles, starts, ends)
    low, high = (np.searchsorted(index.keys, keys, side) for side in ("left", "right"))
    for i in np.flatnonzero((high > low).any(1)).tolist():
        doc = int(owner[i])
        hits = {int(t) for a, b in zip(low[i], high[i], strict=True) if b > a
                for t in index.owners[a:b]}
        for template in sorted(hits):
            own = index.shingles[template]
            length = max(1, int(index.lengths[template]) - SHINGLE + 1)
            begin = max(int(ranges[doc]), int(starts[i]) - length)
            stop = min(int(ranges[doc + 1]), int(ends[i]) + length)
            best = _best_place(shingles[begin:stop], own, length)
            if best and best[0] >= containment:
                share, b, e = best
                first = begin + b - int(ranges[doc])
                size = min(e - b + SHINGLE - 1, int(words.counts[doc]))
                found[doc].append({"license": index.names[template], "containment": share,
                                   "begin": first, "stop": first + size})
    return [_merged(x) for x in found]


def _grid(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of two steps from each step of each text; the last may be shorter."""
    sizes = np.diff(ranges)
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - STEP) // STEP)), 0)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = ranges[:-1][owner] + nth * STEP
    return starts, np.minimum(starts + 2 * STEP, ranges[1:][owner]), owner


def _best_place(shingles: np.ndarray, own: np.ndarray, length: int
                ) -> tuple[float, int, int] | None:
    """(share, begin, end) of the stretch of ``length`` shingles that holds most of the
    template's, the first of equal ones, drawn in to where they begin and end."""
    where = np.flatnonzero(np.isin(shingles, own))
    best = None
    for i in where.tolist():
        inside = where[(where >= i) & (where < i + length)]
        share = len(np.unique(shingles[inside])) / len(own)
        if best is None or share > best[0]:
            best = (share, i, int(inside[-1]) + 1)
    return best


def _merged(found: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(found, key=lambda x: (-x["containment"], x["begin"], x["license"])):
        if not any(x["license"] == y["license"] and x["begin"] < y["stop"]
                   and y["begin"] < x["stop"] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: (x["begin"], x["license"]))
