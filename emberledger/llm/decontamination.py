"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton of all items is built once and broadcast; documents stream their words through
it. Its size is checked: items beyond ``max_item_bytes`` are dealt to blocks with an automaton
each, and the documents pass through the blocks one after the other. Long items are cut into
pieces that share a window less one word, so a block never has to hold a whole one. The driver
builds one block at a time, and after every ``CHAIN`` of them the documents are written out and
their automata given up, so the number of items does not decide how much memory is held.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberledger.llm.shared import add_columns, stored, text_of
from emberledger.llm.tokens import NOT_ALPHANUMERIC, Texts, Words, covered

#: Windows of as many words; a shorter item is one window.
WINDOW = 10
#: Item text of one automaton; some 50 times as much memory.
MAX_ITEM_BYTES = 2 << 20
#: Words of a piece of an item, besides those that it shares with the next.
PIECE_WORDS = 4096
#: Automata that one pass over the documents holds, at most.
CHAIN = 4
#: A document is dropped where more than this share of its words is hit.
MAX_COVERAGE = 0.5


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with what windows end at each state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.word_ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[str] = []
        self.long: dict[int, set[int]] = {}  # state -> items that contain its strings
        self.short: dict[int, list[tuple[int, int]]] = {}  # state -> (words, short item)
        sequences = []
        for name, words in items:
            if words:
                ids = [self.word_ids.setdefault(w, len(self.word_ids)) for w in words]
                sequences.append((len(self.items), ids))
                self.items.append(name)
                self._add(ids)
        for item, ids in sequences:
            state = 0
            for word in ids:
                state = self.next[state][word]
                up = state
                while up > 0 and self.length[up] >= window:
                    if item in (seen := self.long.setdefault(up, set())):
                        break
                    seen.add(item)
                    up = self.link[up]
            if len(ids) < window:
                self.short.setdefault(state, []).append((len(ids), item))
        self.least = min([window, *(n for x in self.short.values() for n, _ in x)])
        # The nearest state up the links, itself included, at which short items end.
        self.near = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.near[state] = state if state in self.short else self.near[self.link[state]]

    def _add(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            there = self.next[last].get(c)
            if there is not None:
                last = (there if self.length[there] == self.length[last] + 1
                        else self._split(last, c, there))
                continue
            new = self._state({}, 0, self.length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def matches(self, ids: list[int]) -> Iterable[tuple[int, int, Iterable[int]]]:
        """(end, words, items) of each window that occurs in the word numbers."""
        state = length = 0
        nexts, links, lengths, window = self.next, self.link, self.length, self.window
        for i, c in enumerate(ids):
            while state and c not in nexts[state]:
                state = links[state]
                length = lengths[state]
            if c in nexts[state]:
                state = nexts[state][c]
                length += 1
            if length >= window:
                s = state
                while lengths[links[s]] >= window:
                    s = links[s]
                yield i + 1, window, self.long[s]
            s = self.near[state]
            while s > 0:
                for n, item in self.short.get(s, ()):
                    if n <= length:
                        yield i + 1, n, (item,)
                s = self.near[self.link[s]]


def item_pieces(text: str | None, window: int, size: int = PIECE_WORDS) -> list[bytes]:
    """The item's words, lower-cased and joined by blanks, in pieces: every window of the item
    lies in one of them, and no piece is shorter than a window unless the item is."""
    texts = Texts.of(pa.array([text or ""], pa.string()))
    words = Words(texts, NOT_ALPHANUMERIC)
    raw, n = texts.data.tobytes(), len(words.begins)
    return [b" ".join(raw[b:e].lower() for b, e in zip(
                words.begins[at:at + size + window - 1], words.ends[at:at + size + window - 1],
                strict=True))
            for at in range(0, max(n - window + 1, min(n, 1)), size)]


def _pieces(items: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for piece in item_pieces(text, window):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name], pa.string()), pa.array([piece.decode()])],
                        names=["item_id", "piece"])

    source = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                          text_of(items).alias("text"))
    return stored(source.mapInArrow(run, "item_id string, piece string"), "leak-items")


class _Matcher:
    """Finds, for the texts of a step, their hit words and the items that occur in them."""

    def __init__(self, automaton: SuffixAutomaton) -> None:
        self.automaton = automaton
        vocabulary = sorted(automaton.word_ids, key=automaton.word_ids.get)
        texts = Texts.of(pa.array(vocabulary, pa.binary()))
        keys = Words(texts, np.zeros(256, bool), lower=True).keys
        order = np.argsort(keys)
        self.keys, self.numbers = keys[order], order

    def __call__(self, words: Words) -> tuple[np.ndarray, list[set[int]]]:
        n, items = len(words.begins), [set() for _ in range(len(words.texts))]
        hit = np.zeros(n, bool)
        if not n or not len(self.keys):
            return hit, items
        at = np.minimum(np.searchsorted(self.keys, words.keys), len(self.keys) - 1)
        known = self.keys[at] == words.keys
        # Only runs of known words, long enough for a window, can hold one.
        new_text = np.zeros(n + 1, bool)
        new_text[words.ranges] = True
        begin = known & ~np.concatenate(([False], known[:-1] & ~new_text[1:-1]))
        end = known & ~np.concatenate((known[1:] & ~new_text[1:-1], [False]))
        begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        enough = ends - begins >= self.automaton.least
        numbers, raw = self.numbers[at], None
        places, sizes = [], []
        for b, e in zip(begins[enough].tolist(), ends[enough].tolist(), strict=True):
            found = list(self.automaton.matches(numbers[b:e].tolist()))
            if not found:
                continue
            owner = items[int(words.owners[b])]
            for stop, size, of in found:
                places.append(b + stop - size)
                sizes.append(size)
                owner.update(of)
        places, sizes = np.asarray(places, np.int64), np.asarray(sizes, np.int64)
        for size in np.unique(sizes):
            hit |= covered(n, places[sizes == size], int(size))
        return hit, items


def cut_spans(words: Words, hit: np.ndarray) -> list[bytes]:
    """The texts without the spans from the first to the last byte of each run of hit words and
    the blanks that follow it."""
    raw, out = words.texts.data.tobytes(), []
    for i in range(len(words.texts)):
        low, high = int(words.ranges[i]), int(words.ranges[i + 1])
        at, stop = int(words.texts.offsets[i]), int(words.texts.offsets[i + 1])
        own = np.flatnonzero(np.diff(np.concatenate(([0], hit[low:high].astype(np.int8), [0]))))
        kept = []
        for b, e in zip(own[::2].tolist(), own[1::2].tolist(), strict=True):
            kept.append(raw[at:int(words.begins[low + b])])
            at = int(words.begins[low + e]) if low + e < high else int(words.ends[high - 1])
        out.append(b"".join([*kept, raw[at:stop]]))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text",
               window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
               max_item_bytes: int = MAX_ITEM_BYTES, cut: bool = True) -> DataFrame:
    """The rows with ``n_words``, ``n_hit`` (words inside an occurrence of a window),
    ``hit_items`` (sorted ids of the items whose windows occur), ``over`` (more than
    ``max_coverage`` of the words are hit) and, if ``cut``, ``clean_text`` without the hit spans.

    ``items`` has (item_id, text). Null and empty texts have no words, nor have such items any
    window; without items nothing is hit. Repeated items each count; rows are judged one by one,
    so repeated rows get equal results. Columns named as the added ones give way.
    """
    pieces = _pieces(items, window)
    total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    blocks = max(1, -(-int(total) // max_item_bytes))
    spark, held = docs.sparkSession, []
    mask, carried = (_unused(docs, n) for n in ("leak_mask", "leak_carried"))
    for block in range(blocks):
        rows = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks)) == block)
        automaton = SuffixAutomaton(
            sorted((r.item_id, r.piece.encode().split(b" ")) for r in rows.toLocalIterator()),
            window)
        held.append(spark.sparkContext.broadcast(automaton))
        last = block == blocks - 1
        if block:  # what earlier blocks found rides along under a name of its own
            docs = docs.withColumn(carried, F.struct(
                F.col(mask).alias("mask"), F.col("hit_items").alias("items")))
        added = {"n_words": "long", "n_hit": "long", "hit_items": "array<string>",
                 "over": "boolean", "clean_text": "string", mask: "binary"}
        for name, needed in (("clean_text", cut and last), (mask, not last)):
            if not needed:
                del added[name]
        docs = _pass(docs.drop(mask), held[-1], text_col, added, carried if block else None,
                     max_coverage)
        if len(held) == CHAIN and not last:
            docs = stored(docs, "leaks")
            while held:
                held.pop().destroy()
    return docs


def _unused(docs: DataFrame, name: str) -> str:
    """The name, longer by as much as it takes to be no column's."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _pass(docs: DataFrame, shared: Broadcast, text_col: str, added: dict[str, str],
          carried: str | None, max_coverage: float) -> DataFrame:
    """One automaton over all documents, with what earlier ones found in ``carried``."""
    def make():
        matcher = _Matcher(shared.value)
        names = shared.value.items

        def work(column, earlier=None):
            words = Words(Texts.of(column), NOT_ALPHANUMERIC, lower=True)
            hit, items = matcher(words)
            found = [{names[i] for i in x} for x in items]
            if earlier is not None:
                for i, row in enumerate(earlier.to_pylist()):
                    low, high = words.ranges[i], words.ranges[i + 1]
                    bits = np.unpackbits(np.frombuffer(row["mask"], np.uint8))
                    hit[low:high] |= bits[:high - low].astype(bool)
                    found[i].update(row["items"])
            before = np.concatenate(([0], np.cumsum(hit)))
            n_hit = before[words.ranges[1:]] - before[words.ranges[:-1]]
            made = [pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                    pa.array(n_hit > max_coverage * words.counts, pa.bool_())]
            if "clean_text" in added:
                clean = cut_spans(words, hit) if hit.any() else None
                made.append(column.cast(pa.string()) if clean is None
                            else pa.array([x.decode() for x in clean], pa.string()))
            if len(added) > len(made):
                made.append(pa.array(
                    [np.packbits(hit[a:b]).tobytes()
                     for a, b in zip(words.ranges[:-1], words.ranges[1:], strict=True)],
                    pa.binary()))
            return made

        return work

    more, ddl = ([carried] if carried else []), ", ".join(f"`{n}` {t}" for n, t in added.items())
    return add_columns(docs, text_col, ddl, make, *more, spent=tuple(more))
