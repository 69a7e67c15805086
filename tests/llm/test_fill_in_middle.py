"""Fill-in-middle against a plain version, and back again."""
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import sha
from odd_rows import ODD, SF

from emberledger.llm import fill_in_middle, queries
from emberledger.llm.tokens import Texts

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
MARKED = [(i, "a <P <S> é > <" * (i % 3) + "ß <P b> M> <" * i) for i in range(40, 90)] + [
    (i, x * 3) for i, x in enumerate(["<P>", "x<S", ">M> y", "<M> ", " <", "P> "], 100)]


def plain(doc, text):
    text = text or ""
    units = TOKENS.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else \
        f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), sha(out), sha(text)


def test_over_documents(spark, given):
    got = {r.doc_id: r for r in queries.op11_fill_in_middle(spark, SF).collect()}
    assert {d: tuple(got[d][1:]) for d, _ in given} == {d: plain(d, t) for d, t in given}


def test_over_odd_and_marked_texts(spark):
    docs = ODD + MARKED
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[2:]) for r in fill_in_middle.digest(frame).collect()}
    assert got == {d: plain(d, t) for d, t in docs}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}
    back = fill_in_middle.restore(fill_in_middle.transform(frame)).collect()
    assert all(r.restored_text == (r.text or "") for r in back) and len(back) == len(docs)


@pytest.mark.parametrize("block", [1, 7, 64 << 10])
def test_blocks_of_any_size_move_bytes_alike(monkeypatch, block):
    monkeypatch.setattr(fill_in_middle, "_BLOCK", block)
    rng = np.random.default_rng(block)
    column = pa.array([t for _, t in ODD] + [t for _, t in MARKED])
    texts = Texts.of(column)
    cuts = fill_in_middle.cuts_of(texts, rng.integers(0, 1 << 32, (len(texts), 4)), 90, 50)
    out, offsets = fill_in_middle.scattered(texts, cuts)
    assert len(out) == len(texts.data) + 9 * (cuts.form > 0).sum()
    back, starts = fill_in_middle.gathered(out, offsets, cuts.form)
    assert (back == texts.data).all() and (starts == texts.offsets).all()


def test_no_rows_null_ids_repeats_long_texts_and_clashing_columns(spark):
    schema = "doc_id long, text string, n string, form int, fim_draws string, middle_chars string"
    assert fill_in_middle.digest(spark.createDataFrame([], schema)).collect() == []
    long = " ".join(f"word{i}" for i in range(200_000))
    rows = [(None, "one two", "x", 1, "y", "z"), (7, long, "x", 1, "y", "z"),
            (7, long, "x", 1, "y", "z"), (8, None, None, None, None, None)]
    got = fill_in_middle.digest(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r[2:]) for r in got) == sorted(
        [plain("", "one two"), plain(7, long), plain(7, long), plain(8, None)])
