"""Fill-in-middle transformation by displacement scatter.

The texts of a batch lie end to end. A scan for token ends gives the cuts of each text; between
the cuts all bytes move by one distance, so a difference array holds a change at each cut only,
and its cumulative sum is the distance of every byte, by which numpy scatters the bytes into the
outputs around the sentinels. The way back reads nothing but outputs and forms: it finds the
sentinels, and the same differences gather the text again. No row leaves its batch: no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberledger.llm.shared import add_columns
from emberledger.llm.tokens import BLANKS, Texts

SEED = "42"
#: Percent of the documents that are transformed, and of those that put the suffix first.
RATE, SPM_RATE = 50, 80
FORMS = ("plain", "psm", "spm")
_PLAIN, _PSM, _SPM = range(3)
_MARKS = b"PSM"  # the letters of the sentinels <P>, <S> and <M>
_WIDTH = 3
#: Bytes that are moved at once.
_BLOCK = 64 << 10


@dataclass
class Cuts:
    """Of each text: number of tokens, form, and the bytes at which middle and suffix begin."""

    tokens: np.ndarray
    form: np.ndarray
    middle: np.ndarray
    suffix: np.ndarray


def token_ends(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(ends, ranges): where each token stops, and each text's range of them. A token is a word
    with the blanks before it; blanks at the end of a text are one more."""
    _begins, ends = texts.pieces(BLANKS)
    stops = texts.offsets[1:][texts.offsets[1:] > texts.offsets[:-1]]
    ends = np.union1d(ends, stops)
    return ends, np.searchsorted(ends, texts.offsets, "right")


def sentinels(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, letter) of all sentinels that lie in one text each."""
    n = len(data)
    if n < _WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    at = np.flatnonzero(data[:n - 2] == ord("<"))
    at = at[data[at + 2] == ord(">")]
    at = at[np.isin(data[at + 1], np.frombuffer(_MARKS, np.uint8))]
    owner = np.searchsorted(offsets, at, "right") - 1
    at = at[at + _WIDTH <= offsets[owner + 1]]
    return at, data[at + 1]


def cuts_of(texts: Texts, draws: np.ndarray, rate: int, spm_rate: int) -> Cuts:
    """The cuts that four random numbers of each text (rows of ``draws``) choose."""
    ends, ranges = token_ends(texts)
    tokens = np.diff(ranges)
    form = np.where(draws[:, 2] % 100 >= rate, _PLAIN,
                    np.where(draws[:, 3] % 100 < spm_rate, _SPM, _PSM))
    marked, _letters = sentinels(texts.data, texts.offsets)
    form[np.searchsorted(texts.offsets, marked, "right") - 1] = _PLAIN
    form[tokens == 0] = _PLAIN
    first, second = (draws[:, i] % (tokens + 1) for i in (0, 1))
    places = []
    for count in (np.minimum(first, second), np.maximum(first, second)):
        at = ranges[:-1] + count - 1
        places.append(np.where(count > 0, ends[np.maximum(at, 0)] if len(ends) else 0,
                               texts.offsets[:-1]))
    return Cuts(tokens, form, *places)


def _moved(source: np.ndarray, begins: np.ndarray, shifts: np.ndarray, size: int,
           scatter: bool) -> np.ndarray:
    """Bytes moved by the shift of the stretch that they lie in; stretches begin at ``begins``.

    Scattering reads ``source`` in order and writes ``size`` bytes; gathering writes in order.
    The differences of the shifts are summed block by block."""
    out = np.zeros(size, np.uint8)
    if not len(begins):
        return out
    changes = np.diff(shifts, prepend=0)
    total, n = 0, len(source) if scatter else size
    edges = np.searchsorted(begins, np.arange(0, n + _BLOCK, _BLOCK))
    for number, at in enumerate(range(0, n, _BLOCK)):
        stop = min(at + _BLOCK, n)
        low, high = edges[number], edges[number + 1]
        moves = np.zeros(stop - at, np.int64)
        np.add.at(moves, begins[low:high] - at, changes[low:high])
        moves[:1] += total
        np.cumsum(moves, out=moves)
        total = int(moves[-1])
        moves += np.arange(at, stop)
        if scatter:
            out[moves] = source[at:stop]
        else:
            out[at:stop] = source[moves]
    return out


def scattered(texts: Texts, cuts: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the outputs of all texts."""
    start, stop = texts.offsets[:-1], texts.offsets[1:]
    changed = cuts.form != _PLAIN
    sizes = stop - start + 3 * _WIDTH * changed
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    base = offsets[:-1]
    psm = cuts.form == _PSM
    n_suffix, n_prefix = stop - cuts.suffix, cuts.middle - start
    # psm: <P> prefix <S> suffix <M> middle; spm: <S> suffix <P> prefix <M> middle
    to_prefix = np.where(psm, base + _WIDTH, base + 2 * _WIDTH + n_suffix)
    to_suffix = np.where(psm, base + 2 * _WIDTH + n_prefix, base + _WIDTH)
    to_middle = base + 3 * _WIDTH + n_prefix + n_suffix
    begins = np.stack((start, cuts.middle, cuts.suffix), 1)
    goals = np.stack((np.where(changed, to_prefix, base),
                      np.where(changed, to_middle, base + cuts.middle - start),
                      np.where(changed, to_suffix, base + cuts.suffix - start)), 1)
    ends = np.stack((cuts.middle, cuts.suffix, stop), 1)
    real = ends > begins
    out = _moved(texts.data, begins[real], (goals - begins)[real], int(offsets[-1]), scatter=True)
    for letter, goal in zip(_MARKS, (to_prefix, to_suffix, to_middle), strict=True):
        for i, byte in enumerate((ord("<"), letter, ord(">"))):
            out[goal[changed] - _WIDTH + i] = byte
    return out, offsets


def gathered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[
        np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, rebuilt from outputs and forms alone."""
    start, stop = offsets[:-1], offsets[1:]
    changed = form != _PLAIN
    at, letter = sentinels(data, offsets)
    owner = np.searchsorted(offsets, at, "right") - 1
    at, letter, owner = at[changed[owner]], letter[changed[owner]], owner[changed[owner]]
    place = {}
    for mark in _MARKS:
        place[mark] = np.zeros(len(form), np.int64)
        place[mark][owner[letter == mark]] = at[letter == mark]
    p, s, m = (place[mark] for mark in _MARKS)
    psm = form == _PSM
    # Each part as (where it lies in the output, how long it is), in the order of the text.
    parts = [(p + _WIDTH, np.where(psm, s, m) - p - _WIDTH),
             (m + _WIDTH, stop - m - _WIDTH),
             (s + _WIDTH, np.where(psm, m, p) - s - _WIDTH)]
    sizes = stop - start - 3 * _WIDTH * changed
    back = np.concatenate(([0], np.cumsum(sizes)))
    begins, sources, lengths, goal = [], [], [], back[:-1]
    for i, (source, length) in enumerate(parts):
        length = np.where(changed, length, sizes if i == 0 else 0)
        begins.append(goal)
        sources.append(np.where(changed, source, start))
        lengths.append(length)
        goal = goal + length
    begins, sources, lengths = (np.stack(x, 1) for x in (begins, sources, lengths))
    real = lengths > 0
    return _moved(data, begins[real], (sources - begins)[real], int(back[-1]),
                  scatter=False), back


def _points(texts: Texts, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of ranges of bytes."""
    starts = np.flatnonzero((texts.data & 0xC0) != 0x80)
    return np.searchsorted(starts, ends) - np.searchsorted(starts, begins)


def _rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[begin:end]


def _with_draws(docs: DataFrame, id_col: str, seed: str) -> DataFrame:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(
        F.col(id_col).cast("string"), F.lit(""))), 256)
    return docs.withColumn("fim_draws", F.array(*[
        F.conv(F.substr(digest, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long")
        for i in range(4)]))


def _add(docs: DataFrame, id_col: str, text_col: str, seed: str, rate: int, spm_rate: int,
         added: str, finish) -> DataFrame:
    def make():
        def work(column, draws):
            texts = Texts.of(column)
            h = draws.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            cuts = cuts_of(texts, h, rate, spm_rate)
            out, offsets = scattered(texts, cuts)
            plain = cuts.form == _PLAIN
            counts = [_points(texts, texts.offsets[:-1], cuts.middle),
                      _points(texts, cuts.middle, cuts.suffix)]
            return [pa.array(cuts.tokens, pa.int64()),
                    pa.array([FORMS[f] for f in cuts.form.tolist()], pa.string()),
                    *(pa.array(c, pa.int64(), mask=plain) for c in counts),
                    *finish(out, offsets, cuts.form)]

        return work

    return add_columns(_with_draws(docs, id_col, seed), text_col,
                       "n long, form string, prefix_chars long, middle_chars long, " + added,
                       make, "fim_draws", spent=("fim_draws",))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
              rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The rows with ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (code points, null if plain) and ``fim_text``.

    A token is a word with the blanks before it. The cuts are drawn from the hash of seed and id;
    of the texts that are neither empty nor hold a sentinel, ``rate`` percent are transformed, and
    ``spm_rate`` percent of those begin with their suffix. Null texts are empty, and a null id
    draws as an empty one. Rows are worked on one by one, so repeated rows get equal results.
    Columns named as the added ones, or ``fim_draws``, give way.
    """
    def finish(out, offsets, _form):
        raw = out.tobytes()
        return [pa.array([raw[b:e].decode() for b, e in zip(
            offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())]

    return _add(docs, id_col, text_col, seed, rate, spm_rate, "fim_text string", finish)


def restore(docs: DataFrame, text_col: str = "fim_text", form_col: str = "form") -> DataFrame:
    """The rows with ``restored_text``: what ``transform`` made ``fim_text`` and ``form`` of.
    A null or unknown form counts as plain. A column named ``restored_text`` gives way."""
    def make():
        def work(column, form):
            texts = Texts.of(column)
            kinds = np.array([FORMS.index(f) if f in FORMS else _PLAIN
                              for f in form.to_pylist()], np.int64)
            data, offsets = gathered(texts.data, texts.offsets, kinds)
            raw = data.tobytes()
            return [pa.array([raw[b:e].decode() for b, e in zip(
                offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())]

        return work

    return add_columns(docs, text_col, "restored_text string", make, form_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED,
           rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """As ``transform``, with ``output_sha256`` in place of the text, and ``restored_sha256`` of
    the text that is rebuilt from output and form (lowercase hex)."""
    def finish(out, offsets, form):
        back, starts = gathered(out, offsets, form)
        return [pa.array([hashlib.sha256(x).hexdigest() for x in _rows(data, places)],
                         pa.string()) for data, places in ((out, offsets), (back, starts))]

    return _add(docs, id_col, text_col, seed, rate, spm_rate,
                "output_sha256 string, restored_sha256 string", finish)
