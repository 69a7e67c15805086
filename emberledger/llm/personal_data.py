"""Personal data: base patterns, and spans that boosted trees add to them.

High-recall generators propose overlapping spans, among them parts of what the base patterns take
as one match and reject. Trees over the spans' format and context say which are personal data;
they learn from the base verdicts on a bounded sample of documents, and a threshold on the
calibrated probability selects. The base spans always stay.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberledger.llm import boosting
from emberledger.llm.quality import calibrate
from emberledger.llm.shared import add_columns, text_of
from emberledger.llm.tokens import mix

KINDS = ("email", "ip", "card", "phone")
#: Documents that the trees learn from, at most; every fourth calibrates them.
SAMPLE_DOCS = 4096
#: Calibrated probability from which a proposed span is taken.
THRESHOLD = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where its digits do: from further on in the same digits it would fail as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")

_DIGITS = re.compile(r"[0-9]+")
_NUMBER_RUN = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_DOTTED_RUN = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_LOOSE_EMAIL = re.compile(
    r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*\x20?(?:@|\[at\]|\(at\))\x20?"
    r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Span = tuple[int, int, int]  # begin, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: int, text: str) -> bool:
    """Whether the text of a match of the kind's pattern passes its check."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in text.split("."))
    digits = "".join(_DIGITS.findall(text)) if kind else ""
    return kind == 0 or (9 <= len(digits) <= 15 if kind == 3
                         else 12 <= len(digits) <= 19 and luhn(digits))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _DOMAIN.match(text, at) if begin < at else None
        if match:
            free = match.end()
            yield begin, free
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, those failing their check left out."""
    found = [(b, 0, e) for b, e in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)
                  if valid(kind, m[0])]
    return sorted(found)


def candidates(text: str) -> list[Span]:
    """Proposed spans, overlapping and of any quality."""
    found = {(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)} if (
        "@" in text or "at" in text) else set()
    for run in _DOTTED_RUN.finditer(text):
        parts = [(m.start(), m.end()) for m in _DIGITS.finditer(text, *run.span())]
        found.update((a[0], 1, b[1]) for a, b in zip(parts, parts[3:], strict=False))
    for run in _NUMBER_RUN.finditer(text):
        groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text, *run.span())]
        for i, (begin, _) in enumerate(groups):
            count = 0
            for first, end in groups[i:]:
                count += end - first
                if count > 19:
                    break
                if count >= 12:
                    found.add((begin, 2, end))
                if 7 <= count <= 15 and end > groups[i][1]:
                    plus = begin > 0 and text[begin - 1] == "+"
                    found.add((begin - plus, 3, end))
    return sorted(found)


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a span."""
    begin, kind, end = span
    part = text[begin:end]
    groups = [m[0] for m in _DIGITS.finditer(part)]
    digits = "".join(groups)
    before, after = text[begin - 1:begin], text[end:end + 1]
    two_before, two_after = text[max(0, begin - 2):begin], text[end:end + 2]
    return [
        kind, len(part), len(digits), len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), float(luhn(digits)) if digits else 0.0,
        max((int(g[-6:]) for g in groups), default=0), float(part[:1] == "+"),
        float(part[:1] == "0"), part.count(" "), part.count("-"), part.count("."),
        part.count("("), float("@" in part), len(part.rpartition(".")[2]),
        float(before.isalpha()), float(before.isdigit()), float(after.isalpha()),
        float(after.isdigit()), float(bool(_DIGITS.search(two_before))),
        float(bool(_DIGITS.search(two_after))), float(before in "\"'=#/_"),
        float(after in "\"'=#/_"), float(before in ".-+(" and before != ""), len(set(digits)),
    ]


def _overlaps(span: Span, others: list[Span]) -> bool:
    return any(span[0] < e and b < span[2] for b, _k, e in others)


def lessons(text: str) -> list[tuple[list[float], bool]]:
    """What the base verdicts say of the proposed spans: true for those that they accept, false
    for those that fail the check or lie across an accepted span of the kind; of the others they
    say nothing."""
    base, out = base_spans(text), []
    for span in candidates(text):
        own = [b for b in base if b[1] == span[1]]
        if span in own:
            out.append((describe(text, span), True))
        elif not valid(span[1], text[span[0]:span[2]]) or _overlaps(span, own):
            out.append((describe(text, span), False))
    return out


def added_spans(text: str, base: list[Span], trees: boosting.Trees | None,
                threshold: float) -> list[Span]:
    """The proposed spans that the trees take, away from the base spans; of overlapping ones the
    most probable, then the first."""
    spans = [s for s in candidates(text) if not _overlaps(s, base)] if trees else []
    if not spans:
        return []
    chances = trees.probabilities(np.array([describe(text, s) for s in spans]))
    taken: list[Span] = []
    for i in np.argsort(-chances, kind="stable"):
        if chances[i] >= threshold and not _overlaps(spans[i], taken):
            taken.append(spans[i])
    return taken


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in sorted(spans))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_docs: int = SAMPLE_DOCS) -> boosting.Trees | None:
    """Trees fitted in one task on at most ``sample_docs`` documents with a digit or an @ sign,
    the first by the hash of their id. None where the base verdicts are all alike."""
    rows = docs.select(F.col(id_col).alias("doc"), text_of(docs, text_col).alias("text"))
    chosen = rows.where("doc is not null and text rlike '[0-9@]'").select("doc").distinct() \
        .orderBy(F.xxhash64("doc"), "doc").limit(sample_docs)
    sample = rows.join(F.broadcast(chosen.withColumnRenamed("doc", "of")),
                       F.col("doc") == F.col("of")).select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = {}
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts[doc] = min(texts.get(doc, text), text)
        order = sorted(texts, key=lambda d: (mix(np.array([hash(d)]))[0], d))
        taught = [(i, *lesson) for i, d in enumerate(order) for lesson in lessons(texts[d])]
        model = None
        if taught:
            number, x, y = (np.array(c) for c in zip(*taught, strict=True))
            held = number % 4 == 3
            if 0 < y[~held].sum() < (~held).sum():
                trees = boosting.fit(x[~held].astype(np.float64), y[~held])
                if held.any():
                    trees.slope, trees.shift = calibrate(
                        trees.scores(x[held].astype(np.float64)), y[held].astype(np.float64))
                model = pickle.dumps(trees)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found and found[0] else None


def find(docs: DataFrame, trees: boosting.Trees | None, text_col: str = "text",
         threshold: float = THRESHOLD) -> DataFrame:
    """The rows with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans of each kind),
    ``base_sha256`` and ``spans``: all spans as kind:start:end in code points, by start and then
    kind, joined by commas. ``redacted`` is the text with each span replaced by its kind; where
    spans overlap, the first one names the whole.

    Null and empty texts have no spans. Rows are judged one by one, so repeated rows get equal
    results. Columns named as the added ones give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        model = shared.value

        def work(column):
            rows = []
            for text in column.to_pylist():
                if not _ANY.search(text) and "at" not in text:
                    rows.append((0, 0, 0, 0, _NOTHING, "", text))
                    continue
                base = base_spans(text)
                spans = base + added_spans(text, base, model, threshold)
                kinds = [k for _b, k, _e in base]
                rows.append((*(kinds.count(k) for k in range(4)),
                             hashlib.sha256(joined(base).encode()).hexdigest(),
                             joined(spans), redact(text, spans)))
            columns = list(zip(*rows, strict=True))
            return [*(pa.array(c, pa.int64()) for c in columns[:4]),
                    *(pa.array(c, pa.string()) for c in columns[4:])]

        return work

    return add_columns(docs, text_col, "n_email long, n_ip long, n_card long, n_phone long, "
                       "base_sha256 string, spans string, redacted string", make)


_NOTHING = hashlib.sha256(b"").hexdigest()


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for begin, kind, end in sorted(spans):
        if begin >= at:
            out += [text[at:begin], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
