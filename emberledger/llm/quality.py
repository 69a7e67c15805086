"""Quality rules: base counts and a calibrated logistic regression over hashed n-grams.

The model is fitted in one task on a bounded sample of labelled documents, chosen by the hash of
their id, and broadcast as one array of fixed size. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberledger.llm.shared import add_columns, text_of
from emberledger.llm.tokens import Texts, Words, covered, mix, windows, within

#: Labelled documents that the model is fitted on, at most; every fourth calibrates it.
SAMPLE_ROWS = 4096
#: Weights of each kind of n-gram: word, word pair, three bytes.
BUCKETS = 1 << 16
#: A document is kept where the calibrated probability of good quality is at least this.
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_ROUNDS, _RATE, _SHRINK = 80, 1.0, 1e-5
_FIT_ROWS = 128  # documents whose n-grams are weighed at once while fitting
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def ngrams(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight numbers, range of each text) of the hashed n-grams, by kind."""
    texts, mask = words.texts, np.uint64(BUCKETS - 1)
    pairs_at = within(words.ranges, 2)
    pairs = windows(words.keys, 2)
    data = texts.data.astype(np.uint64)
    n = max(0, len(data) - 2)
    triples_at = within(texts.offsets, 3)
    triples = mix((data[:n] << np.uint64(16)) | (data[1:n + 1] << np.uint64(8)) | data[2:n + 2])
    out = []
    for kind, (keys, at, ranges, size) in enumerate((
            (words.keys, None, words.ranges, 1), (pairs, pairs_at, words.ranges, 2),
            (triples, triples_at, texts.offsets, 3))):
        keys = keys if at is None else keys[at]
        counts = np.maximum(np.diff(ranges) - size + 1, 0)
        out.append(((keys & mask).astype(np.int64) + kind * BUCKETS,
                    np.concatenate(([0], np.cumsum(counts)))))
    return out


def raw_scores(words: Words, weights: np.ndarray) -> np.ndarray:
    """Of each text: the bias, and for each kind of n-gram the mean weight."""
    total = np.full(len(words.texts), weights[-1])
    for numbers, ranges in ngrams(words):
        sums = np.concatenate(([0.0], np.cumsum(weights[numbers])))
        total += (sums[ranges[1:]] - sums[ranges[:-1]]) / np.maximum(np.diff(ranges), 1)
    return total


def fit(texts: list[str], good: np.ndarray) -> np.ndarray | None:
    """The weights, then bias, slope and shift of the calibration; None with one class only."""
    good = good.astype(np.float64)
    held = np.arange(len(good)) % 4 == 3
    if not 0 < good[~held].sum() < (~held).sum():
        return None
    chunks: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}
    for first in range(0, len(texts), _FIT_ROWS):
        rows: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}
        for i in range(first, min(first + _FIT_ROWS, len(texts))):
            for found, _ranges in ngrams(Words(Texts.of(pa.array([texts[i]])))):
                own, count = np.unique(found, return_counts=True)
                rows[bool(held[i])].append((
                    np.full(len(own), i, np.int32), own.astype(np.int32),
                    (count / max(1, len(found))).astype(np.float32)))
        for side, found in rows.items():
            if found:
                chunks[side].append(tuple(map(np.concatenate, zip(*found, strict=True))))
    size = 3 * BUCKETS
    balance = np.where(good > 0, 0.5 / good[~held].mean(), 0.5 / (1 - good[~held].mean()))
    balance[held] = 0

    def scores(side: bool) -> np.ndarray:
        z = np.full(len(good), bias)
        for o, n, s in chunks[side]:
            z += np.bincount(o, s * w[n], len(good))
        return z

    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, _ROUNDS + 1):
        z = scores(False)
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good) / len(good)
        g, gb = _SHRINK * w / len(good), error.sum()
        for o, n, s in chunks[False]:
            g += np.bincount(n, s * error[o], size)
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        v, vb = 0.99 * v + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        rate = _RATE * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        w -= rate * m / (np.sqrt(v) + 1e-9)
        bias -= 0.1 * rate * mb / (np.sqrt(vb) + 1e-9)
    z = scores(True)
    slope, shift = calibrate(z[held], good[held])
    return np.concatenate((w, [slope, shift, bias]))


def calibrate(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the held-out rows, with the targets drawn
    in a little as for so few rows."""
    n1, n0 = good.sum(), (1 - good).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    target = np.where(good > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, np.abs(z).max())
    x = np.stack((z / scale, np.ones_like(z)), 1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * at)
    return float(at[0] / scale), float(at[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """The model fitted on at most ``sample_rows`` labelled documents, the first by the hash of
    their id. ``labels`` has (doc_id, quality 0/1); null qualities are left out, and of several
    labels or texts of one id the smallest count. None without rows of both classes."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("label_of")).agg(F.min("quality").alias("good"))
        .orderBy(F.xxhash64("label_of"), "label_of").limit(sample_rows)
    )
    sample = docs.select(F.col(id_col).alias("doc"), text_of(docs, text_col).alias("text")).join(
        F.broadcast(chosen), F.col("doc") == F.col("label_of")).drop("label_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict = {}
        for batch in batches:
            for doc, text, good in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows[doc] = min(rows.get(doc, (text, good)), (text, good))
        held = sorted(rows.items(), key=lambda r: mix(np.array([hash(r[0])]))[0])
        model = fit([t for _, (t, _g) in held], np.array([g for _, (_t, g) in held])) \
            if held else None
        yield pa.RecordBatch.from_arrays(
            [pa.array([None if model is None else model.tobytes()], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return None if found is None or found[0] is None else np.frombuffer(found[0], np.float64)


def _repeated(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Items whose key is found twice or more with the same owner."""
    key = mix(keys + mix(owners))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The counts that the base rules stand on, of each text."""
    texts = words.texts

    def per_text(flags: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        before = np.concatenate(([0], np.cumsum(flags)))
        return before[ranges[1:]] - before[ranges[:-1]]

    starts_point = (texts.data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(starts_point)))
    chars = np.concatenate(([0], np.cumsum(points[words.ends] - points[words.begins])))
    at = within(words.ranges, 3)
    keys = windows(words.keys, 3)
    twice = at[_repeated(keys[at], words.owners[at])]
    repeat = covered(len(words.begins), twice, 3)

    breaks = np.arange(256) == 0x0A
    begins, ends = texts.pieces(breaks)
    word_before = np.searchsorted(words.begins, begins), np.searchsorted(words.begins, ends)
    real = word_before[1] > word_before[0]
    begins, ends = begins[real], ends[real]
    ranges = texts.ranges(begins)
    owners = np.repeat(np.arange(len(texts)), np.diff(ranges))
    lines = mix(texts.prints(begins, ends) + mix(owners))
    order = np.argsort(lines, kind="stable")
    later = np.zeros(len(lines), bool)
    later[order[1:][lines[order][1:] == lines[order][:-1]]] = True
    return {
        "n_words": words.counts,
        "word_chars": chars[words.ranges[1:]] - chars[words.ranges[:-1]],
        "n_symbols": per_text(_SYMBOLS[texts.data], texts.offsets),
        "n_dup_lines": per_text(later, ranges),
        "n_repeat_words": per_text(repeat, words.ranges),
    }


def judge(docs: DataFrame, model: np.ndarray | None, text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """The rows with the base counts, ``base_failed``, ``p_good`` (calibrated probability, null
    without a model) and ``kept``.

    Null and empty texts have no words and fail the base rules. Without a model the base rules
    alone decide. Rows are judged one by one, so repeated rows get equal results. Columns named
    as the added ones give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def work(column):
            words = Words(Texts.of(column))
            counts = base_counts(words)
            n = counts["n_words"]
            failed = (n < MIN_WORDS) | (
                100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
            if fitted is None:
                p, kept = pa.nulls(len(n), pa.float64()), ~failed
            else:
                slope, shift = fitted[-3], fitted[-2]
                z = raw_scores(words, fitted) * slope + shift
                good = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                p, kept = pa.array(good), ~failed & (good >= threshold)
            return [*(pa.array(c, pa.int64()) for c in counts.values()),
                    pa.array(failed), p, pa.array(kept)]

        return work

    return add_columns(
        docs, text_col, "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, p_good double, kept boolean", make)
