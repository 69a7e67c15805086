"""Which of many names may occur in which texts, found in one pass over the texts.

A name is known by a hash of its folded characters. A polynomial over the characters of a text gives
the hash of any stretch of it in two look-ups, so the stretches that begin like a name are compared
with all names of their lengths, however many there are: a name costs its entry and some forty bytes,
not a table row for each of its characters. The names are broadcast, and their size is bounded
beforehand: a dictionary that exceeds it is cut by prefix into several tables, each of which goes
over the texts by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberledger.operators.bounds import settled
from emberledger.session import ship_package

#: Characters of the names of one table at most: some 80 MB for names of 18 characters.
TABLE_CHARS = 1 << 23
#: Characters by which a stretch of a text is first compared with the names.
_HEAD = 8
#: Code points from here on have no case.
_CASED = 0x1F000
#: In no text and no name.
_GAP = np.uint32(0xFFFFFFFF)
#: Characters hashed at a time.
_LANE = 1 << 20
#: The base of the hash, which is odd and so has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}

ENTRY = "struct<name_length:int,name:string,token:string,pattern:string>"
_ENTRY_TYPE = pa.struct([("name_length", pa.int32()), ("name", pa.string()),
                         ("token", pa.string()), ("pattern", pa.string())])
_folds: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Folded code point of each code point below ``_CASED``, as patterns of any case compare
    them: upper, then lower, one character each. All white space becomes a blank."""
    if not _folds:
        table = np.arange(_CASED, dtype=np.uint32)
        for code in range(_CASED):
            char = chr(code)
            if char.isspace():
                table[code] = 32
                continue
            upper = char.upper()
            lower = (upper if len(upper) == 1 else char).lower()
            if len(lower) == 1:
                table[code] = ord(lower)
        _folds.append(table)
    return _folds[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _folded(text: str) -> np.ndarray:
    codes = _codes(text)
    return np.where(codes < _CASED, _fold_table()[np.minimum(codes, _CASED - 1)], codes)


def _squeezed(codes: np.ndarray) -> np.ndarray:
    """Which places stay when runs of blanks become one."""
    blank = codes == 32
    stays = np.ones(len(codes), bool)
    stays[1:] = ~(blank[1:] & blank[:-1])
    return stays


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


def _power(base: int, n: int) -> np.ndarray:
    """The powers of a base modulo 2^64, ``n`` of them at least."""
    if base not in _powers or len(_powers[base]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.multiply.accumulate(factors)
    return _powers[base]


class _Hashes:
    """Hashes of stretches of characters: equal for equal ones, wherever they begin."""

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(codes) * _power(_BASE, n)[:n], out=self.sums[1:])
        self.inverse = _power(pow(_BASE, -1, 1 << 64), n + 1)[:n + 1]

    def leading(self, length: int) -> np.ndarray:
        """Of the stretches of a length, from each place on that has one."""
        if length >= len(self.sums):
            return np.zeros(0, np.uint64)
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n])

    def at(self, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[places + lengths] - self.sums[places]) * self.inverse[places])


@dataclass(frozen=True)
class _Heads:
    """First characters of names, ``size`` of them, and how long the names are that have them."""

    size: int
    hashes: np.ndarray    # sorted
    first: np.ndarray     # head -> first place in ``lengths`` of the lengths of its names
    lengths: np.ndarray
    known: np.ndarray     # the leading bits of a hash -> whether a head has them

    @staticmethod
    def of(size: int, heads: np.ndarray, lengths: np.ndarray) -> _Heads:
        order = np.lexsort((lengths, heads))
        heads, lengths = heads[order], lengths[order]
        new = np.ones(len(heads), bool)
        new[1:] = (heads[1:] != heads[:-1]) | (lengths[1:] != lengths[:-1])
        hashes, first = np.unique(heads[new], return_index=True)
        bits = min(max(len(hashes).bit_length() + 4, 10), 24)
        known = np.zeros(1 << bits, bool)
        known[hashes >> np.uint64(64 - bits)] = True
        return _Heads(size, hashes, np.append(first, new.sum()), lengths[new], known)

    def find(self, hashes: _Hashes, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, head) among the first ``n`` places."""
        leading = hashes.leading(self.size)[:n]
        bits = len(self.known).bit_length() - 1
        places = np.flatnonzero(self.known[leading >> np.uint64(64 - bits)])
        head = np.minimum(np.searchsorted(self.hashes, leading[places]), len(self.hashes) - 1)
        same = self.hashes[head] == leading[places]
        return places[same], head[same]


@dataclass(frozen=True)
class NameTable:
    """Names by their hashes."""

    entries: pa.StructArray   # longest name first
    heads: list[_Heads]       # of names of ``_HEAD`` characters and more, and of shorter ones
    hashes: np.ndarray        # of the names, sorted
    order: np.ndarray         # their entries
    longest: int              # squeezed characters of the longest name

    @staticmethod
    def build(entries: pa.StructArray) -> NameTable:
        lengths, hashes, heads = [], [], []
        for step in _steps(entries.field("name")):
            whole = np.array([len(n) for n in step], np.int64)
            codes, start = _folded("".join(step)), np.cumsum(whole) - whole
            stays = _squeezed(codes)
            stays[start[whole > 0]] = True
            kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(stays)])
            length, start = kept[start + whole] - kept[start], kept[start]
            found = _Hashes(codes[stays])
            lengths.append(length)
            hashes.append(found.at(start, length))
            heads.append(found.at(start, np.minimum(length, _HEAD)))
        length, name, head = (np.concatenate([np.zeros(0, t), *x]) for t, x in (
            (np.int64, lengths), (np.uint64, hashes), (np.uint64, heads)))
        sizes = np.minimum(length, _HEAD)
        order = np.argsort(name, kind="stable")
        order = order[length[order] > 0]
        return NameTable(
            entries, [_Heads.of(int(k), head[sizes == k], length[sizes == k])
                      for k in np.unique(sizes) if k],
            name[order], order, int(length.max(initial=0)))

    def _hits(self, codes: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, entry) of the names that may begin at the first ``n`` places."""
        hashes = _Hashes(codes)
        for heads in self.heads:
            places, head = heads.find(hashes, n)
            first, stop = heads.first[head], heads.first[head + 1]
            while len(places):  # one length of each head after the other
                length = heads.lengths[first]
                inside = places + length <= len(codes)
                at = places[inside]
                name = hashes.at(at, length[inside])
                low = np.searchsorted(self.hashes, name)
                count = np.searchsorted(self.hashes, name, side="right") - low
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield np.repeat(at, count), self.order[np.repeat(low, count) + offset]
                more = first + 1 < stop
                places, first, stop = places[more], first[more] + 1, stop[more]

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, entry), by text and then in the order of the entries."""
        rows = [_squeezed_codes(t or "") for t in texts]
        # A character that is in no name keeps neighbours apart.
        stops = np.cumsum([len(r) + 1 for r in rows])
        stream = np.concatenate([x for r in rows for x in (r, np.array([_GAP]))])
        lane = max(_LANE, 2 * self.longest)
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start in range(0, len(stream), lane):
            # Far enough for the names that begin in this lane.
            for place, entry in self._hits(stream[start:start + lane + self.longest], lane):
                owner, entry = _distinct(
                    np.searchsorted(stops, start + place, side="right"), entry)
                owners.append(owner)
                found.append(entry)
        return _distinct(np.concatenate(owners), np.concatenate(found))


def _squeezed_codes(text: str) -> np.ndarray:
    """Folded characters of a text without repeated blanks, made a piece at a time."""
    pieces, blank = [np.zeros(0, np.uint32)], False
    for start in range(0, len(text), 1 << 20):
        codes = _folded(text[start:start + (1 << 20)])
        stays = _squeezed(codes)
        stays[0] &= not (blank and codes[0] == 32)
        blank = codes[-1] == 32
        pieces.append(codes[stays])
    return np.concatenate(pieces)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(a.astype(np.int64) << 32 | b)
    return keys >> 32, keys & 0xFFFFFFFF


def _steps(texts: pa.Array) -> Iterator[list[str | None]]:
    """Some texts at a time, so that what a step keeps is bounded by them or by one long text."""
    step, size = [], 0
    for text in texts:
        step.append(text.as_py())
        size += len(step[-1] or "") + 1
        if size >= 1 << 20:
            yield step
            step, size = [], 0
    if step:
        yield step


def _finder(table) -> Column:
    @F.arrow_udf(f"array<{ENTRY}>")
    def find(texts: pa.Array) -> pa.Array:
        names = table.value
        counts, entries = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for step in _steps(texts):
            owner, entry = names.find(step)
            counts.append(np.bincount(owner, minlength=len(step)))
            entries.append(entry)
        offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), names.entries.take(pa.array(np.concatenate(entries))))

    return find


def _tables(dictionary: DataFrame) -> Iterator[NameTable]:
    """The tables of the dictionary, one after the other, each bounded by ``TABLE_CHARS``."""
    stored = settled(dictionary.select("name_length", "name", "token", "pattern"), "names")
    chars = stored.agg(F.sum("name_length")).first()[0] or 0
    if chars <= TABLE_CHARS:
        parts = [stored]
    else:
        # By prefix: sums over ranges of names, then over the names of a range, number the tables
        # without one task that sees all names.
        ranges = int(chars // TABLE_CHARS) + 1
        ranged = settled(stored.repartitionByRange(ranges, "name").withColumn(
            "_range", F.spark_partition_id()), "name-ranges")
        running = Window.partitionBy("_range").orderBy("name")
        numbered = settled(ranged.withColumn("_part", F.floor(
            F.sum("name_length").over(running) * 2 / TABLE_CHARS)), "name-parts")
        keys = numbered.select("_range", "_part").distinct().orderBy("_range", "_part").collect()
        parts = [numbered.where((F.col("_range") == r) & (F.col("_part") == p)) for r, p in keys]
    for part in parts:
        rows = part.select("name_length", "name", "token", "pattern").toArrow()
        if rows.num_rows:
            rows = rows.sort_by([("name_length", "descending"), ("name", "ascending")])
            yield NameTable.build(rows.cast(pa.schema(list(_ENTRY_TYPE))).to_struct_array()
                                  .combine_chunks())


def with_names(docs: DataFrame, text: str, dictionary: DataFrame, key: str) -> DataFrame:
    """Add ``_names``: the entries of the dictionary that may be in each text, longest first.

    With one table nothing is shuffled. With several, each goes over the keys and texts in a pass of
    its own, and what they find is joined to the texts by key.
    """
    spark = docs.sparkSession
    ship_package(spark)
    finders = [_finder(spark.sparkContext.broadcast(t)) for t in _tables(dictionary)]
    if not finders:
        return docs.withColumn("_names", F.array().cast(f"array<{ENTRY}>"))
    if len(finders) == 1:
        return docs.withColumn("_names", finders[0](F.col(text)))
    found = None
    for finder in finders:
        one = docs.select(F.col(key).alias("_key"), finder(F.col(text)).alias("_names"))
        one = one.where(F.size("_names") > 0)
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("_key").agg(
        F.array_distinct(F.flatten(F.collect_list("_names"))).alias("_names"))
    return docs.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").withColumn(
        "_names", F.array_sort(F.coalesce("_names", F.array().cast(f"array<{ENTRY}>")),
                               _longest_first))


def _longest_first(a: Column, b: Column) -> Column:
    return (
        F.when(a["name_length"] > b["name_length"], -1)
        .when(a["name_length"] < b["name_length"], 1)
        .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    )
