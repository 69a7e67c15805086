"""N-gram Jaccard join by prefix filtering, in place of a tree of count vectors.

Of n shingles a link needs a share, so linked documents have one of the first n - needed + 1 of
their shingles in common, whatever one order all documents follow. Here shingles of rare groups
come first: how many shingles of all documents fall into each hashed group gives the order, so
shared passages, which lie in frequent groups, hardly ever make a pair. These first shingles are an
inverted index (its lists are called leaves below); pairs that meet there are bounded by what
is left of both from that place on, then by the summed minima of short vectors of group counts,
and what survives is verified on the shingles. No index over the vectors themselves is built.

Equal points (documents of equal sets) are one class from the start. Links inside a class, or
between nodes that are joined already, need no look: only the components are asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberledger.llm.components import components
from emberledger.llm.shared import add_columns, steps, stored, text_of
from emberledger.llm.tokens import BLANKS, Texts, Words, mix, windows, within

SIZE, PERCENT = 4, 85
#: Groups that order the coordinates, and groups of the vectors that bound an overlap.
ORDER_BITS, GROUPS = 21, 64
#: Ids that are broadcast to pick the sets of pairs before these are shuffled, at most.
BROADCAST_IDS = 1_000_000
_NO_ID = (1 << 63) - 1  # stands for a null id: the largest


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each text, and each text's range of them."""
    words = Words(Texts.of(column), BLANKS, lower=True)
    keys = windows(words.keys, size)[within(words.ranges, size)]
    n = words.counts
    counts = np.maximum(n - size + 1, 0)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(n), np.uint64)
        for i in short:
            low, high = words.ranges[i], words.ranges[i + 1]
            whole[i] = windows(words.keys[low:high], int(high - low), salt=int(high - low))[0]
        at = np.concatenate(([0], np.cumsum(counts)))[short]
        keys = np.insert(keys, at, whole[short])
        counts[short] = 1
    ranges = np.concatenate(([0], np.cumsum(counts)))
    for low, high in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        keys[low:high].sort()
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    fresh[ranges[:-1][ranges[:-1] < len(keys)]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return keys[fresh], kept[ranges]


def group_of(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def group_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of all documents in each group. Tasks count into arrays of a fixed size, which
    are summed in rounds, sixteen to one."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for part in steps(batches, "text"):
            sets, _ranges = shingle_sets(part.column("text"), size)
            total += np.bincount(group_of(sets), minlength=len(total))
        yield from _packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(value), np.int64)
        yield from _packed(total)

    counts = stored(docs.select("text").mapInArrow(count, "counts binary"), "group-counts")
    rows = counts.count()
    while rows > 1:
        tasks = -(-rows // 16)
        counts = stored(counts.repartition(tasks).mapInArrow(add, "counts binary"),
                        "group-counts")
        rows = counts.count() if tasks > 1 else 1
    value = counts.first()
    total = np.frombuffer(zlib.decompress(value.counts), np.int64) if value else np.zeros(
        1 << ORDER_BITS, np.int64)
    return np.minimum(total, (1 << 32) - 1).astype(np.uint32)


def _packed(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    if total.any():
        yield pa.RecordBatch.from_arrays(
            [pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["counts"])


def leaf_keys(sets: np.ndarray, ranges: np.ndarray, percent: int,
              frequency: np.ndarray) -> list[np.ndarray]:
    """The leaves of each document: its first shingles. Of n shingles a link needs ``percent``
    in a hundred at least, so if two documents share none of the first n - needed + 1 of theirs,
    what is left is too little."""
    order = (frequency[group_of(sets)].astype(np.uint64) << np.uint64(32)) | (
        mix(sets) >> np.uint64(32))
    out = []
    for low, high in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        n = high - low
        first = n - -(-percent * n // 100) + 1 if n else 0
        own = np.lexsort((sets[low:high], order[low:high]))[:first]
        out.append(sets[low:high][own].view(np.int64))
    return out


def _sums(sets: np.ndarray, ranges: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64),
                               np.cumsum(mix(sets ^ mix(np.array([salt]))), dtype=np.uint64)))
        return (sums[ranges[1:]] - sums[ranges[:-1]]).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    places = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(places, flat.astype(np.int64))


def _points(docs: DataFrame, size: int, percent: int,
            frequency: Broadcast | None = None) -> DataFrame:
    """(doc, n, c1, c2): size and fingerprint of the point; with its leaves, given how frequent
    the groups are."""
    def make():
        def work(column):
            sets, ranges = shingle_sets(column, size)
            made = [pa.array(np.diff(ranges), pa.int64()),
                    *(pa.array(_sums(sets, ranges, salt)) for salt in (1, 2))]
            return made if frequency is None else [
                *made, _lists(leaf_keys(sets, ranges, percent, frequency.value))]

        return work

    added = "n long, c1 long, c2 long" + ("" if frequency is None else ", leaves array<long>")
    return add_columns(docs, "text", added, make, spent=("text",))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, counts, shingles): the count vector and the sorted fingerprints as bytes."""
    def make():
        def work(column):
            sets, ranges = shingle_sets(column, size)
            group = (sets & np.uint64(GROUPS - 1)).astype(np.int64)
            n = len(ranges) - 1
            cell = np.repeat(np.arange(n), np.diff(ranges)) * GROUPS + group
            counts = np.bincount(cell, minlength=n * GROUPS).astype("<i4").reshape(n, GROUPS)
            return [pa.array([x.tobytes() for x in counts], pa.binary()),
                    pa.array([sets[a:b].astype("<u8").tobytes() for a, b in zip(
                        ranges[:-1], ranges[1:], strict=True)], pa.binary())]

        return work

    return add_columns(docs, "text", "counts binary, shingles binary", make, spent=("text",))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by the bound on the overlap, then by the shingles."""
    def joined(pairs, column):
        ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(),
                     "pair-ids")
        if ids.count() <= BROADCAST_IDS:  # 8 bytes each; beyond, the join shuffles
            ids = F.broadcast(ids)
        own = sets.select("doc", column).join(ids, F.col("doc") == F.col("id"), "left_semi")
        for side in ("a", "b"):
            pairs = pairs.join(own.select(
                F.col("doc").alias(side), F.col(column).alias(f"{side}_{column}")), side)
        return pairs

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array([np.frombuffer(x, "<i4") for x in batch.column(c).to_pylist()]
                             ).reshape(-1, GROUPS) for c in ("a_counts", "b_counts"))
            most, total = np.minimum(a, b).sum(1), a.sum(1) + b.sum(1)
            keep = pa.array(100 * most >= percent * (total - most))
            yield batch.filter(keep).select(["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a_shingles").to_pylist(),
                            batch.column("b_shingles").to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    near = stored(joined(stored(pairs, "pairs"), "counts").mapInArrow(bound, "a long, b long"), "near")
    return joined(near, "shingles").mapInArrow(exact, "a long, b long")


def _enough(a_rest: str, b_rest: str, a_n: str, b_n: str, percent: int) -> Column:
    """Whether two points of sizes n may overlap enough for a link, if what they share lies in
    the last ``rest`` of their coordinates."""
    return F.least(a_rest, b_rest) * (100 + percent) >= (F.col(a_n) + F.col(b_n)) * percent


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc id, n_shingles, component_id), a row for each row of ``docs``.

    A document's set holds its distinct ``size``-word shingles, lower-cased; of fewer words, the
    whole sequence. Documents link where 100 * intersection >= ``percent`` * union, and
    ``component_id`` is the smallest id that links reach. Null and empty texts have an empty set
    and no links. Rows with equal ids are one document with the links of all of them. Rows
    without an id are one document as well, whose id counts as the largest.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
                         text_of(docs, text_col).alias("text"))
    members = stored(_points(source, size, percent), "members")
    point = ["n", "c1", "c2"]
    classes = members.where("n > 0").groupBy(*point).agg(F.min("doc").alias("node"))
    copies = members.join(classes, point).where("doc <> node").select(
        F.col("node").alias("a"), F.col("doc").alias("b"))

    # One row per class and leaf; a leaf is at most one row in each of its points' many.
    frequency = docs.sparkSession.sparkContext.broadcast(group_counts(source, size))
    leaves = (
        _points(source, size, percent, frequency).where("n > 0")
        .groupBy(*point).agg(F.min("doc").alias("node"), F.first("leaves").alias("leaves"))
        .select("node", "n", F.posexplode("leaves").alias("before", "leaf"))
        .select("leaf", "node", "n", (F.col("n") - F.col("before")).alias("rest"))
        .repartition("leaf")
    )
    # The counts read all columns of the leaves, so that both sides of the join share one shuffle.
    crowded = leaves.groupBy("leaf").agg(
        F.count("*").alias("crowd"), F.min("n").alias("least"), F.max("rest").alias("most"),
        F.max("node").alias("last")).where("crowd > 1")
    met = stored(leaves.join(crowded, "leaf").where(
        _enough("rest", "most", "n", "least", percent) & F.col("last").isNotNull()).select(
        "leaf", "node", "n", "rest", "crowd"), "met")

    wanted = met.select("node").distinct()
    sets = stored(_sets(
        source.join(wanted, F.col("doc") == F.col("node"), "left_semi"), size), "sets")

    # First each node with the best connected point of a leaf that it shares with it most often.
    rank = met.groupBy("node").agg(F.sum("crowd").alias("rank"))
    hubs = met.join(rank, "node").groupBy("leaf").agg(F.max(F.struct(
        "rank", F.col("node").alias("hub"), F.col("n").alias("hub_n"),
        F.col("rest").alias("hub_rest"))).alias("best")).select("leaf", "best.*").drop("rank")
    stars = met.join(hubs, "leaf").where("node <> hub").where(
        _enough("rest", "hub_rest", "n", "hub_n", percent)).groupBy("node", "hub").agg(
        F.count("*").alias("shared"))
    best = Window.partitionBy("node").orderBy(F.desc("shared"), "hub")
    stars = stars.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(
        F.col("node").alias("a"), F.col("hub").alias("b"))
    links = stored(_linked(stars, sets, percent).union(copies), "links")
    roots = components(links)

    # Then whatever else shares a leaf and is not joined yet.
    placed = met.drop("crowd").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    mixed = placed.groupBy("leaf").agg(
        F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    placed = stored(placed.join(mixed.select("leaf"), "leaf"), "placed")
    other = placed.select("leaf", F.col("node").alias("b"), F.col("root").alias("other"),
                          F.col("n").alias("b_n"), F.col("rest").alias("b_rest"))
    rest = placed.join(other, "leaf").where("root <> other and node < b").where(
        _enough("rest", "b_rest", "n", "b_n", percent)).select(
        F.col("node").alias("a"), "b").distinct()
    more = stored(_linked(rest, sets, percent), "more")
    if more.limit(1).count():
        roots = components(links.union(more))

    found = members.join(roots, F.col("doc") == F.col("node"), "left").select(
        F.nullif("doc", F.lit(_NO_ID)).alias(id_col), F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("root", "doc"), F.lit(_NO_ID)).alias("component_id"))
    return found
