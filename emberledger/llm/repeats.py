"""Repeated windows of texts: what suffix-array dedup and substring dedup share.

A text is a sequence of units (bytes, or words). Every window of ``size`` units has an anchor
that depends on its own units only, so equal windows have the same units around equal anchors.
Consecutive windows with one anchor are a run; the units they span are its context, and the units
that every window with that anchor holds are its core. The search goes on from the cores to the
contexts to the windows, and leaves out on the way what is unique:

1. cores that occur once hold no repeated window;
2. a context that occurs again repeats all of its windows;
3. where different contexts share a core, their windows are compared one by one, each context
   once however often it occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberledger.llm.shared import add_columns, steps, stored, text_of
from emberledger.llm.tokens import mix

#: Cores with more contexts than this have their windows dealt out one by one.
CROWD = 4096
#: Bits of the filter that spares unique cores the shuffle (16 MB).
FILTER_BITS = 27
_BITMAP = 4096  # bytes of one of Spark's bit maps
_NO_ID = -(1 << 63)  # stands for a null id: the smallest
_GROUP_ROWS = 4000  # contexts that are compared in one numpy step, at least


@dataclass(frozen=True)
class Kind:
    """A search: its window size, the unit's bytes, and how it looks at texts and contexts.

    ``runs`` gives of a text array, for each run: text number, first window, number of windows,
    core and context fingerprints. ``cut`` gives the units of spans (text number, begin, end) as
    bytes. ``prints`` gives the fingerprints of all windows of laid-out units, window by window.
    ``later``: only windows that are not the first of their kind count as repeated.
    """

    size: int
    unit: int
    runs: Callable[[pa.Array], tuple[np.ndarray, ...]]
    cut: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray], list[bytes]]
    prints: Callable[[bytes, np.ndarray], tuple[np.ndarray, np.ndarray]]
    later: bool


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, mark, text): never null; ``mark`` tells apart texts that share an id."""
    text = text_of(docs, text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("mark"), text.alias("text"))


def doc_id(name: str) -> Column:
    """The id as given, from the key that stands for it."""
    return F.nullif(F.col("doc"), F.lit(_NO_ID)).alias(name)


def _core_filter(cores: DataFrame) -> np.ndarray:
    """A bit map of ``FILTER_BITS`` bits, whatever the number of cores: a core whose bit is not
    set is not among them. A full map lets all through, at the price of the shuffle alone."""
    place = f"shiftrightunsigned(core, {64 - FILTER_BITS})"
    found = cores.groupBy(F.expr(f"bitmap_bucket_number({place})").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(bitmap_bit_position({place}))").alias("bits")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 8 + _BITMAP, np.uint8)
    for row in found:  # numbers count from 1, and bucket 0 holds the number 0 alone
        at = (row.bucket - 1) * _BITMAP
        if row.bucket:
            bits[at:at + _BITMAP] |= np.frombuffer(row.bits, np.uint8)
    return bits


def _passes(core: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether cores may be among those of the filter."""
    place = (core >> np.uint64(64 - FILTER_BITS)).astype(np.int64) - 1
    return (place < 0) | ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _runs(docs: DataFrame, kind: Kind, passing: Broadcast | None = None) -> DataFrame:
    """The runs that pass the filter of cores, or the cores of all runs. Runs of one text with
    equal contexts, of which periodic texts have many, are one row: the first, and ``more``."""
    whole = passing is not None
    schema = ("core long, ctx long, doc long, mark long, lo long, n int, more array<long>"
              if whole else "core long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            owner, lo, n, core, ctx = found = kind.runs(part.column("text"))
            if whole:
                keep = _passes(core, passing.value)
                owner, lo, n, core, ctx = (x[keep] for x in found)
            if not whole:
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64))], ["core"])
                continue
            same = mix(core + mix(ctx + mix(owner)))
            order = np.lexsort((lo, same))
            first = np.ones(len(order), bool)
            first[1:] = same[order][1:] != same[order][:-1]
            rows = order[first]
            more = np.diff(np.append(np.flatnonzero(first), len(order))) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(core[rows].view(np.int64)), pa.array(ctx[rows].view(np.int64)),
                 *(part.column(c).take(pa.array(owner[rows])) for c in ("doc", "mark")),
                 pa.array(lo[rows].astype(np.int64)), pa.array(n[rows].astype(np.int32)),
                 pa.ListArray.from_arrays(
                     np.concatenate(([0], np.cumsum(more))).astype(np.int32),
                     lo[order[~first]].astype(np.int64))],
                ["core", "ctx", "doc", "mark", "lo", "n", "more"])

    return docs.mapInArrow(run, schema)


def _contexts(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """The wanted runs with the units of their contexts."""
    lists = wanted.groupBy("doc", "mark").agg(F.collect_list(
        F.struct("core", "lo", "n", "copies")).alias("runs"))
    schema = "core long, doc long, mark long, lo long, n int, copies long, units binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            runs = part.column("runs")
            owner = np.repeat(np.arange(len(part)), pc.list_value_length(runs).to_numpy())
            core, lo, n, copies = runs.flatten().flatten()
            begin = lo.to_numpy()
            units = kind.cut(part.column("text"), owner, begin,
                             begin + n.to_numpy() - 1 + kind.size)
            yield pa.RecordBatch.from_arrays(
                [core, *(part.column(c).take(pa.array(owner)) for c in ("doc", "mark")),
                 lo, n, copies, pa.array(units, pa.binary())],
                ["core", "doc", "mark", "lo", "n", "copies", "units"])

    # Repeated rows give their contexts once each: the comparisons know them by their places.
    return docs.join(lists, ["doc", "mark"]).select("doc", "mark", "text", "runs").mapInArrow(
        run, schema)


def _window_keys(rows: pa.Table, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context number, offset, key) of each window of the contexts: equal windows of contexts
    with equal cores have equal keys."""
    units = rows.column("units").to_pylist()
    lengths = np.array([len(u) // kind.unit for u in units])
    prints, at = kind.prints(b"".join(units), lengths)
    counts = lengths - kind.size + 1
    owner = np.repeat(np.arange(len(units)), counts)
    offset = at - np.repeat(np.cumsum(lengths) - lengths, counts)
    core = rows.column("core").to_numpy().view(np.uint64)
    return owner, offset, mix(prints + mix(core)[owner])


def _repeated_in_groups(rows: pa.Table, kind: Kind) -> pa.RecordBatch:
    """Spans of the repeated windows of contexts; all contexts of their cores are there."""
    owner, offset, key = _window_keys(rows, kind)
    doc, mark, lo, copies = (rows.column(c).to_numpy() for c in ("doc", "mark", "lo", "copies"))
    at = lo[owner] + offset
    order = (np.lexsort((at, mark[owner], doc[owner], key)) if kind.later
             else np.argsort(key, kind="stable"))
    sorted_key = key[order]
    first = np.ones(len(order), bool)
    first[1:] = sorted_key[1:] != sorted_key[:-1]
    repeated = np.zeros(len(order), bool)
    if kind.later:  # not in the first place, which rows of equal id and text share
        of = order[np.repeat(np.flatnonzero(first), np.diff(np.append(
            np.flatnonzero(first), len(order))))]
        repeated[order] = (doc[owner[order]] != doc[owner[of]]) | (
            mark[owner[order]] != mark[owner[of]]) | (at[order] != at[of])
    elif len(order):
        starts = np.flatnonzero(first)
        total = np.add.reduceat(copies[owner][order], starts)
        repeated[order] = np.repeat(total > 1, np.diff(np.append(starts, len(order))))
        repeated &= copies[owner] == 1  # a context that occurs again is repeated as a whole
    where = np.flatnonzero(repeated)
    new = np.ones(len(where), bool)
    new[1:] = (owner[where][1:] != owner[where][:-1]) | (at[where][1:] != at[where][:-1] + 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(where)) - 1
    of = owner[where[begins]] if len(where) else begins
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[of]), pa.array(mark[of]), pa.array(at[where[begins]]),
         pa.array(at[where[ends]] + kind.size)] if len(where) else
        [pa.array([], pa.int64())] * 4, ["doc", "mark", "begin", "stop"])


_SPAN = "doc long, mark long, begin long, stop long"


def _compare_groups(contexts: DataFrame, kind: Kind) -> DataFrame:
    """Spans of repeated windows, core by core: the cores stream by in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < _GROUP_ROWS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            core = rows.column("core").to_numpy()
            end = int(np.flatnonzero(core != core[-1])[-1]) + 1 if core[0] != core[-1] else 0
            for begin, stop in _parts(core[:end]):
                yield _repeated_in_groups(rows.slice(begin, stop - begin), kind)
            held = rows.slice(end).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            core = rows.column("core").to_numpy()
            for begin, stop in _parts(core):
                yield _repeated_in_groups(rows.slice(begin, stop - begin), kind)

    return contexts.repartition("core").sortWithinPartitions("core").mapInArrow(run, _SPAN)


def _parts(core: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_GROUP_ROWS`` rows that end between cores."""
    edges = np.flatnonzero(core[1:] != core[:-1]) + 1
    begin = 0
    for edge in [*edges.tolist(), len(core)]:
        if edge - begin >= _GROUP_ROWS or edge == len(core) > begin:
            yield begin, edge
            begin = edge


def _compare_windows(contexts: DataFrame, kind: Kind) -> DataFrame:
    """Spans of repeated windows of the crowded cores, each window a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), _GROUP_ROWS):
                rows = pa.Table.from_batches([batch.slice(begin, _GROUP_ROWS)])
                owner, offset, key = _window_keys(rows, kind)
                of = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)),
                     *(rows.column(c).combine_chunks().take(of)
                       for c in ("core", "doc", "mark", "copies")),
                     pa.array(rows.column("lo").to_numpy()[owner] + offset)],
                    ["key", "core", "doc", "mark", "copies", "at"])

    rows = contexts.mapInArrow(
        run, "key long, core long, doc long, mark long, copies long, at long")
    place = F.struct("doc", "mark", "at")
    known = rows.groupBy("key", "core").agg(
        F.sum("copies").alias("total"), F.min(place).alias("first"))
    both = rows.join(known, ["key", "core"])
    repeated = (place != F.col("first")) if kind.later else (
        (F.col("total") > 1) & (F.col("copies") == 1))
    return both.where(repeated).select(
        "doc", "mark", F.col("at").alias("begin"), (F.col("at") + kind.size).alias("stop"))


def repeated_spans(docs: DataFrame, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """The keyed documents dealt out by their id, and (doc, mark, spans): arrays of (begin, stop)
    in units, in no order and overlapping, for the documents with repeated windows."""
    cores = stored(_runs(docs, kind).groupBy("core").count().where("count > 1").select("core"),
                   "cores")
    passing = docs.sparkSession.sparkContext.broadcast(_core_filter(cores))
    runs = stored(_runs(docs, kind, passing).join(cores, "core"), "runs")
    contexts = stored(runs.groupBy("core", "ctx").agg(
        F.sum(F.size("more") + 1).alias("copies"), F.min(F.struct("doc", "mark", "lo", "n")).alias("at")),
        "contexts")
    again = contexts.where("copies > 1").select("core", "ctx", "at")
    copies = runs.join(again, ["core", "ctx"]).withColumn(
        "lo", F.explode(F.concat(F.array("lo"), "more")))
    if kind.later:
        copies = copies.where(F.struct("doc", "mark", "lo", "n") != F.col("at"))
    copies = copies.select("doc", "mark", F.col("lo").alias("begin"),
                           (F.col("lo") + F.col("n") - 1 + kind.size).alias("stop"))

    crowds = contexts.groupBy("core").agg(F.count("*").alias("crowd")).where("crowd > 1")
    mixed = stored(contexts.join(crowds, "core").select(
        "core", "at.*", "copies", "crowd"), "mixed")
    dealt = docs.repartition("doc", "mark")
    spans = copies.union(_compare_groups(
        _contexts(dealt, mixed.where(F.col("crowd") <= CROWD), kind), kind))
    crowded = mixed.where(F.col("crowd") > CROWD)
    if crowded.limit(1).count():
        spans = spans.union(_compare_windows(_contexts(dealt, crowded, kind), kind))
    return dealt, spans.groupBy("doc", "mark").agg(
        F.collect_list(F.struct("begin", "stop")).alias("spans"))


def without_spans(docs: DataFrame, kind: Kind, added: str,
                  finish: Callable[[pa.Array, list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """(doc, added...): ``finish`` gets texts and, for each, its spans as rows (begin, stop)."""
    dealt, spans = repeated_spans(docs, kind)

    def make():
        def work(column, found):
            begins = pc.list_value_length(found).fill_null(0).to_numpy(
                zero_copy_only=False)
            flat = found.flatten()
            pairs = np.stack([x.to_numpy() for x in flat.flatten()], 1) if len(flat) else \
                np.zeros((0, 2), np.int64)
            return finish(column, np.split(pairs, np.cumsum(begins)[:-1]))

        return work

    rows = dealt.join(spans, ["doc", "mark"], "left").select("doc", "text", "spans")
    return add_columns(rows, "text", added, make, "spans", spent=("text", "spans"))


def marked(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of ``n`` units lie in a span."""
    out = np.zeros(n, bool)
    if len(spans):
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        reach = np.maximum.accumulate(spans[:, 1])
        new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
        ends = reach[np.append(new[1:], len(spans)) - 1]
        for begin, end in zip(spans[new, 0].tolist(), ends.tolist(), strict=True):
            out[begin:end] = True
    return out


def in_stretches(n: int, limit: int, size: int,
                 runs: Callable[[int, int], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The runs of one long text of ``n`` units, which ``runs(begin, end)`` finds for stretches
    of ``limit`` windows as if each were a text. A run that is cut in two has two contexts."""
    found = []
    for begin in range(0, max(1, n - size + 1), limit):
        owner, lo, *rest = runs(begin, min(n, begin + limit + size - 1))
        found.append((owner, lo + begin, *rest))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
