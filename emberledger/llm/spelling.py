"""Spelling variant grouping with k-d trees over letter-count vectors.

A word is the point of its letter counts. One edit moves a point by one (a letter more or less)
or two (a letter for another), so near words of given lengths lie within that distance of each
other. For each length a k-d tree, fitted on a bounded sample, cuts the space into cells; every
word stands in its own cell and asks in those cells of its own length and the next whose boxes
the distance reaches. In a cell, trees over its words and over those that ask are walked together
and pairs of boxes that are too far apart are left out; what remains is held against the letters
in their order. Boxes only ever rule pairs out, so the sample decides on speed, not on results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberledger.llm.shared import steps, stored, text_of
from emberledger.llm.tokens import Texts

#: Code points and occurrences of a word at least, and every how many runs lose a letter.
MIN_LETTERS, MIN_COUNT, DROP_EVERY = 5, 3, 97
#: A form occurs at least this many times as often as the word.
FORM_RATIO = 2
#: Words that the trees are fitted on, about, and words of a cell that they aim at.
SAMPLE_WORDS, CELL_WORDS = 32_768, 16_384
_LEAST_SAMPLE = 8  # sampled words of a cell, at least
_HELD_WORDS = 100_000  # distinct words that a task counts before it hands them on
_LEAF = 16  # words of a leaf of the trees within a cell
_AT_ONCE = 1 << 15  # pairs of words that are looked at in one numpy step
_POINT, _SAME, _SHORTER = range(3)

#: Letters a-z and U+00C0 to U+00FF, by Latin-1 code, as coordinates.
LETTERS = 26 + 64
_COORDINATE = np.full(256, -1, np.int16)
_COORDINATE[ord("a"):ord("z") + 1] = np.arange(26)
_COORDINATE[0xC0:] = np.arange(26, LETTERS)

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A"):ord("Z") + 1] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("a"):ord("z") + 1] = True
_LEAD = 0xC3  # the first of the two bytes of U+00C0 to U+00FF

#: What one byte does to the checksum, taken from the library's own results.
_CRC_TABLE = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)],
                      np.uint32)
_CRC_BYTES = 48  # longer words are summed one by one


def checksums(data: np.ndarray, begins: np.ndarray, ends: np.ndarray,
              before: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, each begun from the checksum of what stands before it."""
    sizes = ends - begins
    out = np.zeros(len(begins), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    long = int(np.searchsorted(-sizes[order], -_CRC_BYTES))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[begins[i]:ends[i]].tobytes(), int(before[i]))
    order = order[long:]
    state, at, size = ~before[order].astype(np.uint32), begins[order], sizes[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # ranges longer than k
        state[:n] = _CRC_TABLE[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> 8)
    out[order] = ~state
    return out


def _occurrences(texts: Texts, ids: list[str], least: int, drop_every: int
                 ) -> Iterator[tuple[bytes, int]]:
    """(word, count) of the texts' words of ``least`` code points and more, after the drops."""
    data = _LOWERED[texts.data]
    lead = data == _LEAD
    inside = _ASCII_LETTER[data] | lead
    inside[1:] |= lead[:-1]
    begins, ends = texts.stretches(inside)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    letters = points[ends] - points[begins]
    enough = letters >= least
    begins, ends, letters = begins[enough], ends[enough], letters[enough]
    if not len(begins):
        return
    owner = np.searchsorted(texts.offsets, begins, "right") - 1
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = checksums(data, begins, ends, before[owner]).astype(np.int64)
    dropped, raw = h % drop_every == 0, data.tobytes()
    for i in np.flatnonzero(dropped & (letters > least)).tolist():
        word, at = raw[begins[i]:ends[i]].decode(), int(h[i] % letters[i])
        yield (word[:at] + word[at + 1:]).encode(), 1
    begins, ends = begins[~dropped], ends[~dropped]
    prints = Texts(data, texts.offsets).prints(begins, ends)
    _, first, count = np.unique(prints, return_index=True, return_counts=True)
    for b, e, n in zip(begins[first].tolist(), ends[first].tolist(), count.tolist(), strict=True):
        yield raw[b:e], n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               least: int = MIN_LETTERS, min_count: int = MIN_COUNT,
               drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): words of enough code points that occur often enough in all texts.

    A run of the letters A-Z, a-z and U+00C0 to U+00FF is one word, A-Z in lower case. Where
    ``drop_every`` divides the CRC-32 h of ``<id>:<run>``, the run's code point h % length is left
    out. Null texts have no words; a null id counts as an empty one.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"),
                       text_of(docs, text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in held], pa.string()),
                 pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for part in steps(batches, "text"):
            texts = Texts.of(part.column("text"))
            for word, n in _occurrences(texts, part.column("doc").to_pylist(), least, drop_every):
                held[word] = held.get(word, 0) + n
            if len(held) > _HELD_WORDS:
                yield handed()
        if held:
            yield handed()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= min_count)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the words end to end, one byte each, and where each word begins."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return (np.frombuffer("".join(words).encode("latin-1"), np.uint8),
            np.concatenate(([0], np.cumsum(sizes))))


def letter_counts(words: list[str]) -> np.ndarray:
    """The point of each word: how often each letter occurs in it."""
    letters, begins = spelled(words)
    owner = np.repeat(np.arange(len(words)), np.diff(begins))
    counts = np.bincount(owner * LETTERS + _COORDINATE[letters], minlength=len(words) * LETTERS)
    return counts.reshape(-1, LETTERS).astype(np.int32)


@dataclass
class CellTree:
    """A k-d tree whose leaves are cells: points with ``cut`` or less at ``axis`` go left."""

    axis: list[int]
    cut: list[int]
    below: list[tuple[int, int]]
    cell: list[int]  # of a leaf, else -1

    @classmethod
    def fit(cls, points: np.ndarray, size: int) -> CellTree:
        tree = cls([], [], [], [])
        tree._grow(points, size, [0])
        return tree

    def _grow(self, points: np.ndarray, size: int, cells: list[int]) -> int:
        node = len(self.axis)
        for part, value in ((self.axis, 0), (self.cut, 0), (self.below, (0, 0)), (self.cell, -1)):
            part.append(value)
        spread = points.var(0) if len(points) > size else np.zeros(1)
        axis = int(spread.argmax())
        if not spread[axis]:
            self.cell[node], cells[0] = cells[0], cells[0] + 1
            return node
        values = points[:, axis]
        cut = int(np.median(values))
        cut = cut if cut < values.max() else cut - 1
        left = values <= cut
        self.axis[node], self.cut[node] = axis, cut
        self.below[node] = (self._grow(points[left], size, cells),
                            self._grow(points[~left], size, cells))
        return node

    def reached(self, points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of all cells whose boxes lie within the distance of the points."""
        rows, cells = [], []
        far = 1 << 30
        todo = [(0, np.arange(len(points)), np.zeros(len(points), np.int64), {})]
        while todo:
            node, of, gap, box = todo.pop()
            if self.cell[node] >= 0:
                rows.append(of)
                cells.append(np.full(len(of), self.cell[node]))
                continue
            axis, cut = self.axis[node], self.cut[node]
            low, high = box.get(axis, (-far, far))
            x = points[of, axis]
            others = gap - np.maximum(low - x, 0) - np.maximum(x - high, 0)
            for child, lo, hi in zip(self.below[node], (low, cut + 1), (cut, high), strict=True):
                own = others + np.maximum(lo - x, 0) + np.maximum(x - hi, 0)
                near = own <= distance
                if near.any():
                    todo.append((child, of[near], own[near], {**box, axis: (lo, hi)}))
        return np.concatenate(rows), np.concatenate(cells)


_WHOLE = CellTree([0], [0], [(0, 0)], [0])  # of a length without a sampled word


def fit_cells(words: DataFrame, sample_words: int = SAMPLE_WORDS,
              cell_words: int = CELL_WORDS) -> dict[int, CellTree]:
    """A tree for each length, fitted on about ``sample_words`` words chosen by their hash."""
    total = words.count()
    share = min(1.0, sample_words / max(1, total))
    # The hash is uniform, so a share of its range is that share of the words.
    sample = [r.word for r in words.where(
        F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select(
        "word").collect()]
    by_length: dict[int, list[str]] = {}
    for word in sorted(sample):
        by_length.setdefault(len(word), []).append(word)
    size = max(_LEAST_SAMPLE, int(cell_words * share))
    return {n: CellTree.fit(letter_counts(of), size) for n, of in by_length.items()}


def _dealt(words: DataFrame, trees: dict[int, CellTree]) -> DataFrame:
    """(cell, role, word, n): each word in its own cell and in those where it asks.

    Of two cells of one length only the later one is asked, so that no pair comes up twice."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            all_words = batch.column(0).to_pylist()
            lengths = np.fromiter(map(len, all_words), np.int64, len(all_words))
            for n in np.unique(lengths).tolist():
                every = np.flatnonzero(lengths == n)
                for at in range(0, len(every), 4096):
                    some = every[at:at + 4096]
                    points = letter_counts([all_words[i] for i in some.tolist()])
                    tree = own.get(n, _WHOLE)
                    row, cell = tree.reached(points, 2)
                    home = np.zeros(len(some), np.int64)
                    at_home, in_cell = tree.reached(points, 0)
                    home[at_home] = in_cell
                    later = cell > home[row]
                    up, above = own.get(n + 1, _WHOLE).reached(points, 1)
                    rows = np.concatenate((np.arange(len(some)), row[later], up))
                    keys = np.concatenate(((n << 32) + home, (n << 32) + cell[later],
                                           ((n + 1) << 32) + above))
                    roles = np.repeat([_POINT, _SAME, _SHORTER],
                                      [len(some), int(later.sum()), len(up)])
                    taken = batch.take(pa.array(some[rows]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(roles, pa.int32()), *taken.columns],
                        ["cell", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(
        run, "cell long, role int, word string, n long")


class _Boxes:
    """A balanced k-d tree over points: at each level the boxes around equal parts of them."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        depth = max(0, int(np.ceil(np.log2(max(1, n / _LEAF)))))
        width = -(-n // (1 << depth))
        self.order = np.concatenate((np.arange(n), np.full((width << depth) - n, n - 1)))
        self.real = np.arange(len(self.order)) < n
        for level in range(depth):
            rows = self.order.reshape(1 << level, -1)
            # A few points of each part tell along which axis it spreads most.
            some = points[rows[:, ::max(1, rows.shape[1] // 32)]].astype(np.float32)
            axis = some.var(1).argmax(1)
            sort = np.argsort(points[rows, axis[:, None]], axis=1, kind="stable")
            size = rows.shape[1]
            if size % 2:  # the middle row stands on both sides
                middle = sort[:, size // 2:size // 2 + 1]
                sort = np.concatenate((sort[:, :size // 2], middle, middle, sort[:, size // 2 + 1:]),
                                      1)
                real = np.take_along_axis(self.real.reshape(1 << level, -1), sort, 1)
                real[:, size // 2 + 1] = False
            else:
                real = np.take_along_axis(self.real.reshape(1 << level, -1), sort, 1)
            self.order = np.take_along_axis(rows, sort, 1).ravel()
            self.real = real.ravel()
        self.width = len(self.order) >> depth
        parts = points[self.order].reshape(1 << depth, self.width, -1)
        self.low, self.high = [parts.min(1)], [parts.max(1)]
        for _ in range(depth):
            for side, best in ((self.low, np.minimum), (self.high, np.maximum)):
                side.insert(0, best(side[0][::2], side[0][1::2]))

    @property
    def depth(self) -> int:
        return len(self.low) - 1


def _close(one: _Boxes, two: _Boxes, levels: tuple[int, int], p: np.ndarray, q: np.ndarray,
           distance: int) -> np.ndarray:
    out = np.zeros(len(p), bool)
    for at in range(0, len(p), 2048):
        a, b = p[at:at + 2048], q[at:at + 2048]
        gap = np.maximum(one.low[levels[0]][a] - two.high[levels[1]][b], 0)
        gap += np.maximum(two.low[levels[1]][b] - one.high[levels[0]][a], 0)
        out[at:at + 2048] = gap.sum(1) <= distance
    return out


def near_leaves(one: _Boxes, two: _Boxes, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves whose boxes lie within the distance; of one tree with itself, each once."""
    p = q = np.zeros(1, np.int64)
    i = j = 0
    while i < one.depth or j < two.depth:
        if i < one.depth:
            p, q, i = np.concatenate((2 * p, 2 * p + 1)), np.concatenate((q, q)), i + 1
        if j < two.depth:
            p, q, j = np.concatenate((p, p)), np.concatenate((2 * q, 2 * q + 1)), j + 1
        if one is two:
            p, q = p[p <= q], q[p <= q]
        keep = _close(one, two, (i, j), p, q, distance)
        p, q = p[keep], q[keep]
    return p, q


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def _one_more(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether the longer words without one letter are the shorter ones."""
    n = shorter.shape[1]
    front = np.logical_and.accumulate(longer[:, :n] == shorter, 1).sum(1)
    back = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], 1).sum(1)
    return front + back >= n


class Cell:
    """Words of one length with their letters, points and tree."""

    def __init__(self, words: list[str], axes: np.ndarray | None = None) -> None:
        letters, begins = spelled(words)
        self.letters = letters.reshape(len(words), -1)
        points = letter_counts(words)
        bits = np.uint64(1) << (np.arange(LETTERS) % 64).astype(np.uint64)
        self.odd = np.zeros(len(words), np.uint64)
        for axis in range(LETTERS):
            self.odd ^= np.where(points[:, axis] & 1, bits[axis], np.uint64(0))
        # Axes along which the cell's own words lie at zero can be left out: less is ruled out.
        self.axes = np.flatnonzero(points.any(0)) if axes is None else axes
        kind = np.int16 if points.max(initial=0) < 1 << 14 else np.int32
        self.tree = _Boxes(np.ascontiguousarray(points[:, self.axes].astype(kind)))


def near_pairs(points: Cell, asking: Cell | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): words i of the cell that differ by one letter from the words j that ask, of the
    same length or one letter shorter; without any that ask, from other words of the cell."""
    other = points if asking is None else asking
    shorter = points.letters.shape[1] > other.letters.shape[1]
    distance, check = (1, _one_more) if shorter else (2, _one_replaced)
    one, two = points.tree, other.tree
    p, q = near_leaves(one, two, distance)
    odd = [x.odd[x.tree.order].reshape(-1, x.tree.width) for x in (points, other)]
    size = one.width * two.width
    step = max(1, _AT_ONCE // size)
    held, n_held = [], 0

    def checked() -> tuple[np.ndarray, np.ndarray]:
        pair, cell = np.divmod(np.concatenate(held), size)
        x, y = p[pair] * one.width + cell // two.width, q[pair] * two.width + cell % two.width
        i, j = one.order[x], two.order[y]
        use = one.real[x] & two.real[y]
        if asking is None:
            use &= (p[pair] != q[pair]) | (i < j)  # a leaf meets itself both ways
        i, j = i[use], j[use]
        good = check(points.letters[i], other.letters[j])
        return i[good], j[good]

    for at in range(0, len(p), step):
        # One edit changes at most two counts from odd to even or back.
        changed = np.bitwise_count(odd[0][p[at:at + step]][:, :, None]
                                   ^ odd[1][q[at:at + step]][:, None, :])
        held.append(np.flatnonzero(changed <= distance) + at * size)
        n_held += len(held[-1])
        if n_held > _AT_ONCE:
            yield checked()
            held, n_held = [], 0
    if n_held:
        yield checked()


def _search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways, of the near words in one cell."""
    role = rows.column("role").to_numpy()
    of = [rows.filter(pa.array(role == r)) for r in (_POINT, _SAME, _SHORTER)]
    if not len(of[_POINT]):
        return
    points = Cell(of[_POINT].column("word").to_pylist())
    for kind, table in ((None, of[_POINT]), (_SAME, of[_SAME]), (_SHORTER, of[_SHORTER])):
        if not len(table):
            continue
        asking = None if kind is None else Cell(table.column("word").to_pylist(), points.axes)
        for i, j in near_pairs(points, asking):
            a, b = of[_POINT].take(pa.array(i)), table.take(pa.array(j))
            for x, y in ((a, b), (b, a)):
                yield pa.RecordBatch.from_arrays(
                    [c.combine_chunks() for c in (x.column("word"), y.column("word"),
                                                  y.column("n"))], ["word", "near", "near_n"])


def near_words(words: DataFrame, trees: dict[int, CellTree] | None = None) -> DataFrame:
    """(word, near, near_n): the words (word, n), each once, that differ by exactly one inserted,
    deleted or replaced letter; every pair stands both ways."""
    trees = fit_cells(words) if trees is None else trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != cell[begin]:
                    yield from _search(pa.Table.from_batches(held).combine_chunks())
                    held = []
                if end > begin:
                    held.append(batch.slice(begin, end - begin))
        if held:
            yield from _search(pa.Table.from_batches(held).combine_chunks())

    return _dealt(words, trees).repartition("cell").sortWithinPartitions("cell").mapInArrow(
        run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of the chain of forms. A form occurs
    at least twice as often as its word, so chains end; each round halves what is left of them."""
    now = stored(forms.where("form is not null").select("word", F.col("form").alias("root")),
                 "roots")
    while True:
        above = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        new = stored(now.join(above, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"),
            F.col("above").isNotNull().alias("moved")), "roots")
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        now = new.drop("moved")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   least: int = MIN_LETTERS, min_count: int = MIN_COUNT,
                   drop_every: int = DROP_EVERY, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of ``vocabulary``.

    Words are near if they differ by exactly one inserted, deleted or replaced code point, and
    ``n_near`` counts them. ``form`` is the near word of the largest n (of equal ones the first
    in code-point order) if that ``form_n`` is at least ``ratio`` times the word's n, else null;
    ``root`` follows the forms to the last, and is the word itself where there is none.

    Repeated rows count as often as they stand there. Empty tables have no words. Only the id and
    the text are read, so other columns cannot clash.
    """
    words = stored(vocabulary(docs, id_col, text_col, least, min_count, drop_every), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(
            (-F.col("near_n")).alias("fewer"), F.col("near").alias("form"))).alias("best"))
    enough = -F.col("best.fewer") >= ratio * F.col("n")
    forms = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"),
        F.when(enough, -F.col("best.fewer")).alias("form_n")), "forms")
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
