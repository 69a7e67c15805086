"""Substring dedup by the first level of recompression.

Further levels are left out: windows are verified on their words instead. The rounds name runs of
equal tokens, then pairs of neighbours of which the first falls on one side of a global coin and
the second on the other. A name is a fingerprint of what it stands for, so
it is the same in all documents and needs no dictionary. Whether a boundary between symbols is
left by a round depends on the symbols beside it only; each boundary carries the range of words
that its survival rests on. Equal windows therefore hold the same surviving boundaries wherever
that range lies inside, and the boundary whose pair of neighbours has the smallest name is the
anchor of both. Shared symbols around anchors reveal repeats, which are verified on the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberledger.llm.repeats import Kind, doc_id, in_stretches, keyed, marked, without_spans
from emberledger.llm.tokens import Texts, Words, mix, windows, within

#: Words of a repeated window, and rounds of pairs after the one of runs.
WINDOW, ROUNDS = 20, 1
_STRETCH = 1 << 17  # windows of a long text that are looked at together
_FAR = 1 << 40  # a boundary of the text itself rests on what no window holds


def _name(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(3) + mix(right + np.uint64(salt)))


def boundaries(keys: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, from, to, name) of the boundaries that the rounds leave: the first word after
    each, the words that its survival and name rest on, and the name of the pair around it."""
    starts = np.unique(ranges[:-1][ranges[:-1] < ranges[1:]])
    edge = np.zeros(len(keys) + 1, bool)
    edge[starts] = True
    edge[-1] = True
    stay = edge.copy()
    stay[1:-1] |= keys[1:] != keys[:-1]
    place = np.flatnonzero(stay)
    low = np.where(edge[place], -_FAR, place - 1)
    high = np.where(edge[place], _FAR, place + 1)
    with np.errstate(over="ignore"):
        names = mix(keys[place[:-1]] + mix(np.diff(place)))
    for number in range(ROUNDS):
        side = (mix(names + np.uint64(101 + number)) & np.uint64(1)).astype(bool)
        merge = side[:-1] & ~side[1:] & ~edge[place[1:-1]]  # across the inner boundaries
        stay = np.concatenate(([True], ~merge, [True]))
        left = np.concatenate(([-_FAR], low[:-1]))
        right = np.concatenate((high[1:], [_FAR]))
        outer = edge[place]
        low, high = np.where(outer, -_FAR, left), np.where(outer, _FAR, right)
        at = np.flatnonzero(stay)
        first = at[:-1]
        double = np.diff(at) == 2
        names = np.where(double, _name(names[first], names[np.minimum(first + 1, len(names) - 1)],
                                       number), names[first])
        place, low, high = place[at], low[at], high[at]
    inner = np.flatnonzero(~edge[place])
    return (place[inner], low[inner - 1], high[inner + 1],
            _name(names[inner - 1], names[inner], 99))


def anchored_runs(column: pa.Array, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``size`` words that share an anchor; see ``repeats.Kind.runs``."""
    words = Words(Texts.of(column))
    if len(words.texts) > 1 or len(words.begins) <= _STRETCH:
        return _runs(words.keys, words.ranges, size)
    return in_stretches(len(words.begins), _STRETCH, size, lambda begin, end: _runs(
        words.keys[begin:end], np.array([0, end - begin]), size))


def _runs(keys: np.ndarray, ranges: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    n = len(keys)
    at, none = within(ranges, size), np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    place, low, high, name = boundaries(keys, ranges)
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    anchor = np.full(n, -1, np.int64)
    rank, first, last = (np.zeros(n + size, t) for t in (np.uint64, np.int64, np.int64))
    first[:] = -_FAR
    rank[place], first[place], last[place] = name, low, high
    starts = np.arange(n)
    for ahead in range(1, size):
        r, f, t = (x[ahead:ahead + n] for x in (rank, first, last))
        better = (f >= starts) & (t <= starts + size) & (r < best)
        best[better] = r[better]
        anchor[better] = starts[better] + ahead
    whole = windows(keys, size)
    anchor = anchor[at]
    alone = anchor < 0
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | alone[1:]
    begin = np.flatnonzero(new)
    lo, hi = at[begin], at[np.append(begin[1:], len(at)) - 1]
    anchor, alone = anchor[begin], alone[begin]
    # The core is what the anchor rests on; a window without an anchor is its own.
    a, b = np.where(alone, lo, first[anchor]), np.where(alone, lo + size, last[anchor])
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        factor = np.uint64(0xD1342543DE82EF95)
        up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, factor))))
        down = np.multiply.accumulate(np.concatenate(
            ([np.uint64(1)], np.full(n, np.uint64(pow(int(factor), -1, 1 << 64))))))
        np.cumsum(keys * up[:n], out=sums[1:])
        core = mix((sums[b] - sums[a]) * down[a] + mix((b - a) << 8 | alone))
        context = mix((whole[lo] ^ mix(whole[hi])) + mix((hi - lo) << 20 | (
            np.where(alone, 0, anchor - lo))))
    owner = np.searchsorted(ranges, lo, "right") - 1
    return owner, lo - ranges[owner], hi - lo + 1, core, context


def _cut(column: pa.Array, owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    words = Words(Texts.of(column))
    raw, start = words.keys.tobytes(), words.ranges[owner]
    return [raw[8 * b:8 * e] for b, e in zip(
        (start + begin).tolist(), (start + end).tolist(), strict=True)]


def kind_of(size: int) -> Kind:
    def prints(units: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = within(np.concatenate(([0], np.cumsum(lengths))), size)
        return windows(np.frombuffer(units, np.uint64), size, salt=1)[at], at

    return Kind(size, 8, lambda column: anchored_runs(column, size), _cut, prints, later=True)


def _kept(column: pa.Array, spans: list[np.ndarray]) -> tuple[list[int], list[int], list[bytes]]:
    words = Words(Texts.of(column))
    raw, counts, removed, kept = words.texts.data.tobytes(), [], [], []
    for i, own in enumerate(spans):
        low, high = int(words.ranges[i]), int(words.ranges[i + 1])
        stay = np.arange(low, high)
        if len(own):
            gone = marked(high - low, own)
            stay = stay[~gone]
        parts = []
        for at in range(0, len(stay), _STRETCH):
            some = stay[at:at + _STRETCH]
            parts.append(b" ".join([raw[b:e] for b, e in zip(
                words.begins[some].tolist(), words.ends[some].tolist(), strict=True)]))
        kept.append(b" ".join(parts))
        counts.append(high - low)
        removed.append(high - low - len(stay))
    return counts, removed, kept


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = WINDOW) -> DataFrame:
    """(doc id, n_words, n_removed, kept_text): each document without the words in a window of
    ``size`` words whose sequence also starts earlier, in a document with a smaller id or further
    up in the same one; what is kept is joined by single blanks. Windows are judged on the input.

    Null and empty texts have no words. Of rows with equal ids and equal texts none comes before
    the other, so they share one fate, that of the first; with different texts the order is that
    of a checksum. A null id is the smallest. Only the id and the text are read, so other columns
    cannot clash.
    """
    def finish(column, spans):
        counts, removed, kept = _kept(column, spans)
        return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array([x.decode() for x in kept], pa.string())]

    return without_spans(
        keyed(docs, id_col, text_col), kind_of(size),
        "n_words long, n_removed long, kept_text string", finish,
    ).select(doc_id(id_col), "n_words", "n_removed", "kept_text")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           size: int = WINDOW) -> DataFrame:
    """As ``dedup_windows``, with ``kept_sha256`` (lowercase hex) in place of the text."""
    def finish(column, spans):
        counts, removed, kept = _kept(column, spans)
        return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]

    return without_spans(
        keyed(docs, id_col, text_col), kind_of(size),
        "n_words long, n_removed long, kept_sha256 string", finish,
    ).select(doc_id(id_col), "n_words", "n_removed", "kept_sha256")
