"""SimHash near-dedup by bit-sliced comparison.

Fingerprints within the radius differ in few of ``BLOCKS`` blocks of bits, so they agree on some
choice of the other blocks. Each distinct fingerprint is dealt out under all choices, and a group
holds those with equal bits there. A group is stored by bit planes: plane b has bit b of its
fingerprints, one after the other. Moving all planes by d places sets each fingerprint against
the d-th after it; carry-save counters of single bits add up the differing planes for 64 pairs
with one word, and words of which all pairs exceed the radius are abandoned. Groups larger than a
tile meet tile by tile. What leaves a group is a tree of links, not all of its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger.llm.components import components
from emberledger.llm.shared import add_columns, stored, text_of

#: Words of a shingle, differing bits of a link at most, and the seed of the shingles' hash.
SIZE, RADIUS, SEED = 4, 4, 42
#: Blocks of bits: fingerprints that link agree on all but ``RADIUS`` of them at least.
BLOCKS = 7
#: Fingerprints of a tile: larger groups are compared by pairs of tiles, a group a pair.
TILE = 8192
_NO_ID = (1 << 63) - 1  # stands for a null id: the largest
_CHUNK = 128 << 10  # bytes of a text whose shingles are hashed at once
_ROWS = 32768  # fingerprints that are compared in one numpy step, at least
_WORD = 64
_LANES = np.uint64(0x0101010101010101)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; bytes split at just the blanks of the contract."""
    at, n = 0, len(raw)
    while at < n:
        found = _BLANK.search(raw, at + _CHUNK)
        stop = found.start() if found else n
        yield raw[at:stop].split()
        at = stop


def simhash(raw: bytes, size: int = SIZE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a lower-cased text: bits set in over half of the hashes of its
    shingles, repeats included; of fewer words, of the whole sequence; zero without words."""
    ones, total = np.zeros(_WORD, np.int64), 0
    tail: list[bytes] = []
    for words in _word_lists(raw):
        words = tail + words
        tail = words[max(0, len(words) - size + 1):] if size > 1 else []
        if len(words) >= size:
            ones += _ones(words, size, seed)
            total += len(words) - size + 1
    if not total and tail:
        ones, total = _ones(tail, len(tail), seed), 1
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def _ones(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """How many hashes of the shingles have each bit set."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[b:e], seed) for b, e in zip(
        begins[:n].tolist(), ends[size - 1:].tolist(), strict=True)], np.uint64)
    # Every eighth bit is a lane of eight, in which up to 255 hashes can be counted.
    hashes = np.concatenate((hashes, np.zeros(-n % 255, np.uint64))).reshape(-1, 255)
    out = np.zeros((8, 8), np.int64)
    for k in range(8):
        counts = ((hashes >> np.uint64(k)) & _LANES).sum(1)
        out[:, k] = counts.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return out.ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SIZE, seed: int = SEED) -> DataFrame:
    """(doc, fp): the fingerprints as signed 64-bit numbers; a null id is the largest."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
                       text_of(docs, text_col).alias("text"))

    def make():
        def work(column):
            found = [simhash(t.lower(), size, seed)
                     for t in column.cast(pa.binary()).to_pylist()]
            return [pa.array(np.array(found, np.uint64).view(np.int64))]

        return work

    return add_columns(rows, "text", "fp long", make, spent=("text",))


def block_keys(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of the choices of blocks of which linked fingerprints agree on one at least."""
    edges = [_WORD * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(x) for x in combinations(masks, max(1, blocks - radius))]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


class _Planes:
    """Bit planes of fingerprints that stand group by group, the largest groups first."""

    def __init__(self, prints: np.ndarray) -> None:
        self.n = len(prints)
        words = -(-self.n // _WORD)
        bits = np.zeros((words * _WORD, _WORD), np.uint8)
        bits[:self.n] = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1,
                                      bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        self.planes = np.zeros((_WORD, words + 2), np.uint64)
        self.planes[:, :words] = np.ascontiguousarray(packed).view(np.uint64)

    def near(self, lanes: np.ndarray, distance: int, radius: int) -> tuple[
            np.ndarray, np.ndarray]:
        """(i, j) of the pairs within the radius. ``lanes`` has the pairs to look at: bit b of
        word w in row r stands for i = 64 w + b and j = i + distance + r; ``distance`` is a
        multiple of 64 and there are 64 rows."""
        row, word = np.nonzero(lanes)
        live = lanes[row, word]
        shift, far = row.astype(np.uint64), word + distance // _WORD
        back = np.uint64(_WORD - 1) - shift  # in two steps, as a shift by 64 is undefined
        limit = _bits_of(radius)
        counter = [np.zeros(len(live), np.uint64) for _ in limit]
        over = np.zeros(len(live), np.uint64)
        for plane in range(0, _WORD, 3):
            differ = []
            for p in self.planes[plane:plane + 3]:
                after = (p[far] >> shift) | ((p[far + 1] << np.uint64(1)) << back)
                differ.append(p[word] ^ after)
            for weight, value in enumerate(_saved(differ)):
                for level in range(weight, len(counter)):
                    counter[level], value = counter[level] ^ value, counter[level] & value
                over |= value
            if plane % 12 == 9:
                over |= _exceeds(counter, limit)
                keep = np.flatnonzero(live & ~over)
                if len(keep) < len(live):
                    row, word, live, shift, far, back, over = (
                        x[keep] for x in (row, word, live, shift, far, back, over))
                    counter = [c[keep] for c in counter]
                if not len(keep):
                    break
        live = live & ~(over | _exceeds(counter, limit))
        some = np.flatnonzero(live)
        bits = np.unpackbits(live[some].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        at, lane = np.nonzero(bits)
        i = word[some][at] * _WORD + lane
        return i, i + distance + row[some][at]


def _bits_of(radius: int) -> list[bool]:
    return [bool(radius >> k & 1) for k in range(max(1, radius.bit_length()))]


def _saved(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Sum and carry of up to three planes."""
    if len(planes) == 1:
        return planes
    a, b = planes[:2]
    c = planes[2] if len(planes) > 2 else np.zeros_like(a)
    half = a ^ b
    return [half ^ c, (a & b) | (half & c)]


def _exceeds(counter: list[np.ndarray], limit: list[bool]) -> np.ndarray:
    """Lanes whose count is above the limit."""
    above = np.zeros_like(counter[0])
    equal = ~above
    for value, bit in zip(reversed(counter), reversed(limit), strict=True):
        if bit:
            equal = equal & value
        else:
            above |= equal & value
            equal = equal & ~value
    return above


def _label_pairs(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives the rows joined by pairs (i, j) the smallest of their labels."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        root = np.arange(len(labels))
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        labels[:] = root[labels]


def group_links(group: np.ndarray, side: np.ndarray, prints: np.ndarray, radius: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): links that join the rows within the radius in each group, at most one fewer than
    its rows. ``side`` is 0 where a row meets all rows of its group, else 1 or 2: rows of one
    tile, which meet those of the other tile only."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.append(starts, len(group)))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    sizes = sizes[order]
    rows = np.repeat(starts[order] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) \
        + np.arange(sizes.sum())
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n, prints, side = len(rows), np.ascontiguousarray(prints[rows]), side[rows]
    size = np.repeat(sizes, sizes)
    rest = size - 1 - (np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    labels, planes = np.arange(n), _Planes(prints)
    words = -(-n // _WORD)
    spread = np.lib.stride_tricks.sliding_window_view
    for distance in range(0, int(sizes[0]), _WORD):
        first = int(np.searchsorted(-size, -distance))  # rows of groups larger than that
        first = min(n, -(-first // _WORD) * _WORD)
        lanes = np.zeros((_WORD, words), np.uint64)
        padded = np.concatenate((labels, np.full(distance + 2 * _WORD, -1)))
        tile = np.concatenate((side, np.zeros(distance + 2 * _WORD, side.dtype)))
        for at in range(0, first, 4096):
            stop = min(at + 4096, first)
            ahead = np.arange(distance, distance + _WORD)
            window = slice(at + distance, stop + distance + _WORD - 1)
            use = (rest[at:stop, None] >= ahead) & (ahead > 0)
            use &= spread(padded[window], _WORD) != labels[at:stop, None]
            use &= (side[at:stop, None] == 0) | (spread(tile[window], _WORD)
                                                 != side[at:stop, None])
            packed = np.packbits(use.T, axis=1, bitorder="little")
            wide = np.zeros((_WORD, -(-(stop - at) // _WORD) * 8), np.uint8)
            wide[:, :packed.shape[1]] = packed
            lanes[:, at // _WORD:at // _WORD + wide.shape[1] // 8] = wide.view(np.uint64)
        if lanes.any():
            _label_pairs(labels, *planes.near(lanes, distance, radius))
    joined = np.flatnonzero(labels != np.arange(n))
    return rows[labels[joined]], rows[joined]


def _compare(dealt: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of nodes; groups stream by in order."""
    def links(rows: pa.Table) -> pa.RecordBatch:
        key, part, side, fp, node = (rows.column(c).to_numpy() for c in (
            "key", "part", "side", "fp", "node"))
        new = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        group = np.concatenate(([0], np.cumsum(new)))
        i, j = group_links(group, side, fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < _ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            last = pc.and_(pc.equal(rows["key"], rows["key"][-1]),
                           pc.equal(rows["part"], rows["part"][-1]))
            whole = len(rows) - int(pc.sum(last).as_py())
            if whole:
                yield links(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def near_links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
               tile: int = TILE) -> DataFrame:
    """Links (a, b) of the nodes of distinct fingerprints (fp, node): enough of them to join all
    that are within the radius.

    A group of more than ``tile`` fingerprints is dealt out in tiles by their hash, each row to
    the pairs of its tile with every tile, so that no task holds more than two tiles of it."""
    masks = block_keys(radius, blocks)
    if len(masks) > 64:
        raise ValueError("too many choices of blocks")
    keys = classes.select("fp", "node", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"),
                 F.col("fp").bitwiseAND(_signed(mask)).alias("bits"))
        for i, mask in enumerate(masks)])).alias("k")).select(
        F.xxhash64("k.choice", "k.bits").alias("key"), "fp", "node")
    crowds = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > tile)
                    .select(F.col("key").alias("crowd"), F.ceil(F.col("n") / tile).alias("tiles")),
                    "crowds")
    met = keys.join(crowds, F.col("key") == F.col("crowd"), "left")
    own = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("tiles"))
    met = met.select("key", "fp", "node", "tiles", F.when(
        F.col("tiles").isNotNull(), own).alias("own")).select(
        "key", "fp", "node", "tiles", "own", F.explode(F.when(
            F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    alone = F.col("tiles").isNull() | (F.col("own") == F.col("other"))
    met = met.select(
        "key", "fp", "node",
        F.when(F.col("tiles").isNull(), 0).otherwise(low * F.col("tiles") + high)
        .cast("long").alias("part"),
        F.when(alone, 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        .cast("int").alias("side"))
    return _compare(met.repartition("key", "part").sortWithinPartitions("key", "part"), radius)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = SIZE, radius: int = RADIUS) -> DataFrame:
    """(doc id, fingerprint, component_id), a row for each row of ``docs``.

    ``fingerprint`` is the SimHash of the lower-cased text over its ``size``-word shingles, as 16
    hexadecimal digits. Documents link where at most ``radius`` bits differ, and ``component_id``
    is the smallest id that links reach. Null and empty texts have the fingerprint zero and link
    like others. Rows with equal ids are one document with the links of all of them. Rows without
    an id are one document as well, whose id counts as the largest (2^63 - 1, which comes back as
    null). Only the id and the text are read, so other columns cannot clash.
    """
    members = stored(fingerprints(docs, id_col, text_col, size), "simhash")
    classes = stored(members.groupBy("fp").agg(F.min("doc").alias("node")), "classes")
    near = near_links(classes, radius)
    same = members.join(classes, "fp").where("doc <> node").select(
        F.col("node").alias("a"), F.col("doc").alias("b"))
    roots = components(near.union(same))
    return members.join(roots, F.col("doc") == F.col("node"), "left").select(
        F.nullif("doc", F.lit(_NO_ID)).alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif(F.coalesce("root", "doc"), F.lit(_NO_ID)).alias("component_id"))
