"""Token counts of a unigram vocabulary by a count-only Viterbi search.

An Aho-Corasick automaton enumerates the pieces that occur in a text; dynamic programming over
its positions carries the best score and the number of pieces, no path. Ties go by the rule of
the unigram tokenizer: at each end the piece that begins first keeps its place against later ones
of equal score. No piece crosses into a white-space marker, so the marked words are counted apart
and those seen before come from a bounded table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from emberledger.llm.sentence_pieces import MARKER, TABLE_CHARS, TABLE_ENTRIES, chunks
from emberledger.llm.shared import add_columns

#: Below the lowest score of the vocabulary: what a character without a piece costs.
UNKNOWN_PENALTY = 10.0


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a piece file: ordinary pieces, and those of single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())
            if not model.is_control(i)]


class PieceCounter(dict):
    """Chunk (without its first marker) -> number of pieces of its best segmentation."""

    def __init__(self, model_path: str) -> None:
        import ahocorasick

        super().__init__()
        pieces = [(p, s) for p, s in vocabulary(model_path)
                  if p and not (len(p) == 6 and p.startswith("<0x") and p.endswith(">"))
                  and p != "<unk>"]
        if any(MARKER in p.lstrip(MARKER) for p, _ in pieces):
            raise ValueError("a piece of this vocabulary crosses a white-space marker")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY

    def __missing__(self, chunk: str) -> int:
        count = self.count(MARKER + chunk.replace(" ", MARKER))
        if len(chunk) <= TABLE_CHARS:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
            self[chunk] = count
        return count

    def count(self, text: str) -> int:
        """Pieces of the best segmentation; a character without a piece counts as its bytes.

        The automaton gives the pieces that end at one place longest first, so a later one must
        score more; an unknown character is the last that is tried at its end.
        """
        n, at = len(text), 0
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            while at < last:
                at += 1
                self._unknown(text, best, pieces, at)
            total = best[end - length] + score
            if not pieces[end] or total > best[end]:
                best[end], pieces[end] = total, pieces[end - length] + 1
        while at < n:
            at += 1
            self._unknown(text, best, pieces, at)
        return pieces[n]

    def _unknown(self, text: str, best: list[float], pieces: list[int], end: int) -> None:
        """Tries the character before ``end`` as an unknown one, if it has no piece."""
        char = text[end - 1]
        if char not in self.single:
            total = best[end - 1] + self.unknown
            if not pieces[end] or total > best[end]:
                best[end], pieces[end] = total, pieces[end - 1] + len(char.encode())


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """The rows with ``n_tokens``: the pieces of each whole text, without begin and end ids.

    The vocabulary is that of the piece file, read as a unigram model: a piece's score is its
    log-likelihood. Null and empty texts have none. Rows are counted one by one, so repeated rows
    get equal counts. A column named ``n_tokens`` gives way.
    """
    def make():
        counter = PieceCounter(model_path)

        def work(column):
            return [pa.array([sum(map(counter.__getitem__, chunks(t)))
                              for t in column.to_pylist()], pa.int64())]

        return work

    return add_columns(docs, text_col, "n_tokens long", make)
