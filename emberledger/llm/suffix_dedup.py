"""Suffix-array dedup over sampled positions, in place of prefix doubling.

Ranking every byte position by pairs of ranks would put many times the text into each shuffle, so
only sampled positions (anchors) are ranked, of which every window of the threshold's length holds
one that depends on its own bytes only. The length that is compared grows: anchors are grouped by
their first ``CORE`` bytes, those of a unique group are done, the others are grouped anew with
their whole context, past the threshold; where contexts differ, positions are compared one by one
by the whole threshold. A rank is a fingerprint, which Spark counts and joins; nothing is reranked
by pairs at doubled offsets. Equal strings have equal ranks in all documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberledger.llm.repeats import Kind, doc_id, in_stretches, keyed, marked, without_spans
from emberledger.llm.tokens import Texts, fingerprints, mix, within

#: Bytes of a repeated string, and bytes by which anchors are ranked first.
THRESHOLD, CORE = 200, 48
_SEED = 12  # bytes whose hash says which position becomes an anchor
_STRETCH = 1 << 20  # windows of a long text that are looked at together


def _lowest(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` consecutive values."""
    reach = 1
    while reach * 2 <= span:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = span - reach
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchored_runs(column: pa.Array, size: int, core: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``size`` bytes that share an anchor; see ``repeats.Kind.runs``."""
    texts = Texts.of(column)
    if len(texts) > 1 or len(texts.data) <= _STRETCH:
        return _runs(texts, size, core)
    return in_stretches(len(texts.data), _STRETCH, size, lambda begin, end: _runs(
        Texts(texts.data[begin:end], np.array([0, end - begin])), size, core))


def _runs(texts: Texts, size: int, core: int) -> tuple[np.ndarray, ...]:
    n, none = len(texts.data), np.zeros(0, np.int64)
    at = within(texts.offsets, size)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = texts.sums()
    eight = np.ndarray(n - 7, "<u8", np.ascontiguousarray(texts.data), strides=(1,))
    value = mix(eight[:n - _SEED + 1] ^ mix(eight[_SEED - 8:]))
    low = np.uint64(0xFFFFFFFF)
    order = (value & ~low) | np.arange(len(value)).astype(np.uint64)  # the first of equal wins
    anchor = (_lowest(order, size - core + 1)[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    starts = np.flatnonzero(new)
    first, last = at[starts], at[np.append(starts[1:], len(at)) - 1]
    anchor = anchor[starts]
    owner = np.searchsorted(texts.offsets, first, "right") - 1
    place = mix(((anchor - first) << 32 | (last - first)).astype(np.uint64))
    return (owner, first - texts.offsets[owner], last - first + 1,
            fingerprints(sums, anchor, anchor + core),
            mix(fingerprints(sums, first, last + size) + place))


def _cut(column: pa.Array, owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    texts = Texts.of(column)
    raw, start = texts.data.tobytes(), texts.offsets[owner]
    return [raw[b:e] for b, e in zip((start + begin).tolist(), (start + end).tolist(),
                                     strict=True)]


def kind_of(threshold: int) -> Kind:
    if threshold < _SEED:
        raise ValueError(f"the threshold has to be {_SEED} bytes at least")
    core = min(CORE, threshold)

    def prints(units: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        texts = Texts(np.frombuffer(units, np.uint8), offsets)
        at = within(offsets, threshold)
        return fingerprints(texts.sums(salt=1), at, at + threshold), at

    return Kind(threshold, 1, lambda column: anchored_runs(column, threshold, core), _cut,
                prints, later=False)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: int = THRESHOLD) -> DataFrame:
    """(doc id, n_bytes, n_removed, n_spans, kept): each document's UTF-8 bytes without those in
    a string of ``threshold`` bytes that starts anywhere else too, in the same document or in
    another; ``kept`` is binary, as a cut may fall inside a character. ``n_spans`` counts the
    maximal removed runs. Strings are judged on the input and never cross documents.

    Null texts are empty. Repeated rows repeat each other's strings, so all of them lose them.
    Null ids are kept. Only the id and the text are read, so other columns cannot clash.
    """
    def finish(column, spans):
        return _result(column, spans, lambda kept: kept, pa.binary())

    return without_spans(
        keyed(docs, id_col, text_col), kind_of(threshold),
        "n_bytes long, n_removed long, n_spans long, kept binary", finish,
    ).select(doc_id(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           threshold: int = THRESHOLD) -> DataFrame:
    """As ``dedup_bytes``, with ``kept_sha256`` (lowercase hex) in place of the bytes."""
    def finish(column, spans):
        return _result(column, spans, lambda kept: hashlib.sha256(kept).hexdigest(), pa.string())

    return without_spans(
        keyed(docs, id_col, text_col), kind_of(threshold),
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string", finish,
    ).select(doc_id(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _result(column, spans, of_kept, kept_type):
    texts, rows = Texts.of(column), []
    for i, own in enumerate(spans):
        data = texts.data[texts.offsets[i]:texts.offsets[i + 1]]
        gone = marked(len(data), own) if len(own) else np.zeros(len(data), bool)
        edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) > 0 and gone[0])
        rows.append((len(data), int(gone.sum()), int(edges), of_kept(data[~gone].tobytes())))
    sizes, removed, runs, kept = zip(*rows, strict=True)
    return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(runs, pa.int64()), pa.array(kept, kept_type)]
