"""Suffix-array and substring dedup against plain versions."""
import random

import brute
import pytest
from odd_rows import ODD, SF

from emberledger.llm import queries, recompression, repeats, suffix_dedup


def rows(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def woven(seed):
    """Documents put together from shared passages, runs, periods and words of their own."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(15, 90))] for _ in range(6)]
    shared += [["run"] * 50, ["a", "b"] * 40, ["x", "y", "z"] * 25]
    out = []
    for doc in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            part = list(rng.choice(shared)) if rng.random() < .6 else [
                rng.choice(words) for _ in range(rng.randrange(5, 60))]
            if rng.random() < .5:
                part = part[rng.randrange(len(part)):]
            if rng.random() < .3:
                part[rng.randrange(len(part))] = f"edit{rng.randrange(99)}"
            text += part
        out.append((doc * 3 % 61, rng.choice([" ", "  ", "\n"]).join(text)))
    return out


CASES = [(suffix_dedup.digest, brute.repeated_bytes), (recompression.digest, brute.repeated_words)]


@pytest.mark.parametrize("work, plain", CASES)
def test_over_documents(spark, given, work, plain):
    name = {suffix_dedup.digest: "op1_suffix_dedup", recompression.digest: "op5_substring_dedup"}
    assert rows(queries.QUERIES[name[work]](spark, SF)) == plain(given)


@pytest.mark.parametrize("crowd", [4096, 3])
@pytest.mark.parametrize("work, plain", CASES)
def test_over_woven_and_odd_texts(spark, monkeypatch, work, plain, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    docs = woven(1) + [(100 + d, t) for d, t in ODD]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = plain(docs)
    assert rows(work(df)) == want
    assert sum(v[1] > 0 for v in want.values()) > 30


@pytest.mark.parametrize("work", [suffix_dedup.dedup_bytes, recompression.dedup_windows])
def test_no_rows_null_ids_repeated_rows_and_clashing_columns(spark, work):
    schema = "doc_id long, text string, n_words long, mark string, spans string"
    assert work(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(f"token{i}" for i in range(40))
    docs = spark.createDataFrame(
        [(None, text, 1, "", ""), (5, text, 1, "", ""), (5, text, 1, "", ""), (7, None, 1, "", ""),
         (5, "other", 1, "", "")], schema)
    got = sorted((r[0] or -1, r[2]) for r in work(docs).collect())
    if work is recompression.dedup_windows:
        assert got == [(-1, 0), (5, 0), (5, 40), (5, 40), (7, 0)]
    else:
        assert got == [(-1, len(text)), (5, 0), (5, len(text)), (5, len(text)), (7, 0)]


@pytest.mark.parametrize("crowd", [4096, 3])
def test_repeated_rows_keep_the_first_occurrence(spark, monkeypatch, crowd):
    """Repeated rows beside documents that share a part of their text: all rows of a document
    get what it gets as one row."""
    monkeypatch.setattr(repeats, "CROWD", crowd)
    passage = [f"p{i}" for i in range(60)]
    docs = [(d, " ".join([f"a{d}x{i}" for i in range(9)] + passage[d:50 + d]
                         + [f"b{d}x{i}" for i in range(9)])) for d in range(1, 7)]
    docs += [(10 + d, t) for d, t in woven(2)]
    df = spark.createDataFrame(docs + docs[:1] * 2 + docs[3:5] + docs[9:30],
                               "doc_id long, text string").repartition(4)
    want = brute.repeated_words(docs)
    got = recompression.digest(df).collect()
    assert len(got) == len(docs) + 25 and {tuple(r) for r in got} == {
        (d, *v) for d, v in want.items()}
