"""The pipeline against the plain versions chained, and its stages on odd rows."""
import sys
from pathlib import Path

import brute
import pytest
from odd_rows import ODD, SF

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from emberledger.llm import queries  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


def kept_lines(docs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)

    holders = {}
    for doc, text in docs.items():
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    return {doc: "\n".join(
        x for x in (text or "").split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3
        or max(holders[key(x)]) == doc) for doc, text in docs.items()}


def test_whole_run(spark, given):
    """Row for row what the plain versions give, the quality verdicts taken as they are."""
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    docs = dict(given)
    good = {r.doc_id for r in queries.op4_quality_rules(spark, SF).where("kept").collect()}
    docs = kept_lines({d: t for d, t in docs.items() if d in good})
    classes = brute.near_classes(list(docs.items()))
    docs = {d: t for d, t in docs.items() if classes[d][1] == d}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(
        f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = brute.leaks(list(docs.items()), items)
    assert set(rows) == {d for d in docs if found[d][1] <= .5 * found[d][0]}
    clean = {d: docs[d] for d in rows if not found[d][4]}
    want = brute.sentence_pieces(list(clean.items()), queries.piece_model())
    assert {d: (rows[d].n_tokens, rows[d].decoded_sha256) for d in clean} == {
        d: (n, text) for d, (n, _ids, text) in want.items()}
    assert len(clean) > 100 and len(clean) < len(given)


@pytest.mark.parametrize("name", STAGES)
def test_stages_on_odd_rows(spark, name):
    """Nulls in every column, repeated rows, columns with the operators' own names."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, kept string, "
              "n_words string, mark string")
    rows = [(d, t, None, "s", None if t is None else len(t), "a", "b", "c") for d, t in ODD]
    rows += [rows[10], (None,) * 8, (None,) * 8]
    docs = spark.createDataFrame(rows, schema)
    got = STAGES[name](spark, docs, SF)
    if name != "tokens":
        assert got.columns == docs.columns
        for r in got.collect():
            assert r.n_chars is None or r.n_chars == len(r.text)
    else:
        assert got.count() == len(rows)
    assert STAGES[name](spark, docs.limit(0), SF).count() == 0
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert len(ids) <= len(rows) and set(ids) <= {r[0] for r in rows}
    if name in ("line_dedup", "decontamination"):
        assert len(ids) == len(rows)


def test_near_copies_are_those_of_five_words_and_eighty_percent(spark):
    """One block of each copy is changed, from none of it to more than links at all."""
    docs = []
    for family in range(4):
        base = [f"w{family}x{i}" for i in range(100)]
        docs += [(100 * family + cut, " ".join(base[:100 - cut] + [
            f"e{family}y{cut}z{i}" for i in range(cut)])) for cut in (0, 7 + family, 30)]
    rows = spark.createDataFrame(
        [(d, t, None, "s", len(t)) for d, t in docs],
        "doc_id long, text string, lang string, source string, n_chars long")
    want, loose = (brute.near_classes(docs, *x) for x in ((5, 80), (4, 85)))
    assert want != loose
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, rows, SF).collect()}
    assert got == {d for d in want if want[d][1] == d}
