"""SentencePiece encoding and decoding through tables of distinct chunks.

No piece of the vocabulary crosses into a white-space marker, so the marked words of a text
(its chunks: markers, then what follows) are segmented independently of each other. Each
distinct chunk is segmented once per task and its ids are joined back by position. A table over
all documents would need every word occurrence in a shuffle, several times the text; the tables
are therefore the tasks' own, and bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emberledger.llm.shared import add_columns

MARKER = "▁"
#: Entries of a task's table before it is begun anew, and the longest chunk that it keeps.
TABLE_ENTRIES, TABLE_CHARS = 200_000, 48


class ChunkTable(dict):
    """Chunk (without its first marker) -> little-endian ids and decoded bytes."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.marker_id = self.model.piece_to_id(MARKER)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any(MARKER in p.lstrip(MARKER) for p in pieces):
            raise ValueError("a piece of this vocabulary crosses a white-space marker")

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        # The library puts a marker before a text, but gives nothing for an empty one.
        ids = self.model.encode(chunk) if chunk else [self.marker_id]
        entry = np.asarray(ids, "<u4").tobytes(), self.model.decode(ids).encode()
        if len(chunk) <= TABLE_CHARS:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[chunk] = entry
        return entry


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker; none for an empty text."""
    parts = text.replace(MARKER, " ").split(" ")
    if "" not in parts:
        return parts
    if parts == [""]:
        return []
    out, i, n = [], 0, len(parts)
    for empty, run in groupby(parts, key=lambda p: not p):
        k = sum(1 for _ in run)
        i += k
        if not empty:
            out += parts[i - k:i]
        elif i == n:
            out.append(" " * (k - 1))
        else:
            parts[i] = " " * k + parts[i]
    return out


def encode_texts(table: ChunkTable, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Ids with begin and end ids, little-endian, and the decoded texts."""
    bos = np.asarray([table.model.bos_id()], "<u4").tobytes()
    eos = np.asarray([table.model.eos_id()], "<u4").tobytes()
    ids, decoded = [], []
    for text in texts:
        entries = [table[c] for c in chunks(text)]
        ids.append(b"".join([bos, *(e[0] for e in entries), eos]))
        decoded.append(b" ".join([e[1] for e in entries]))
    return ids, decoded


def _worker(model_path: str, finish: Callable[[list[bytes], list[bytes]], list[pa.Array]]):
    def make():
        table = ChunkTable(model_path)
        return lambda column: finish(*encode_texts(table, column.to_pylist()))

    return make


def encode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The rows with ``token_ids`` (array of int, begin and end ids included) and
    ``decoded_text``, as the sentencepiece library gives them for the whole text.

    Null and empty texts have the two outer ids alone and decode to an empty text. Every row is
    worked on by itself, so repeated rows and ids are as good as others. Columns named as the
    added ones give way.
    """
    def finish(ids, decoded):
        places = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        return [pa.ListArray.from_arrays(places, flat),
                pa.array([x.decode() for x in decoded], pa.string())]

    return add_columns(docs, text_col, "token_ids array<int>, decoded_text string",
                       _worker(model_path, finish))


def digest(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The rows with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of what ``encode``
    gives; ids and decoded texts do not leave their task."""
    def hexes(values):
        return pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())

    def finish(ids, decoded):
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), hexes(ids), hexes(decoded)]

    return add_columns(docs, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                       _worker(model_path, finish))
