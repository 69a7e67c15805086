"""Operators against plain versions, on odd rows and on the smallest test tables."""
import brute
import pytest
from pyspark.sql import functions as F
from odd_rows import ODD, SF

from emberledger.llm import decontamination, line_dedup, queries, quality, sentence_pieces

DOCS = "doc_id long, text string"


def rows(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("name, plain", [
    ("op2_line_dedup", brute.line_dedup),
    ("op3_sentence_pieces", lambda d: brute.sentence_pieces(d, queries.piece_model())),
])
def test_query_over_documents(spark, given, name, plain):
    assert rows(queries.QUERIES[name](spark, SF)) == plain(given)


def test_lines_of_odd_texts(odd):
    got = line_dedup.dedup_lines(odd).select("doc_id", "n_lines", "n_dropped", "line_text")
    want = brute.line_dedup(ODD)
    assert {d: (a, b, brute.sha(c)) for d, (a, b, c) in rows(got).items()} == want
    assert want[7][1] == 2 and want[9][1] == 0


def test_pieces_of_odd_texts(odd):
    model = queries.piece_model()
    assert rows(sentence_pieces.digest(odd, model).drop("text")) == brute.sentence_pieces(
        ODD, model)
    whole = rows(sentence_pieces.encode(odd, model).drop("text"))
    assert whole[1] == ([1, 2], "") and whole[10][1] == brute.BLANK_WORDS.sub(
        lambda m: m[0], dict(ODD)[10])


def test_quality_base_counts(spark, odd, given):
    got = rows(quality.judge(odd, None).drop("text"))
    assert {d: v[:6] for d, v in got.items()} == brute.quality_base(ODD)
    assert all(v[7] is not v[5] for v in got.values())
    model = rows(queries.op4_quality_rules(spark, SF))
    assert {d: v[:6] for d, v in model.items()} == brute.quality_base(given)


def test_quality_model_holds_out(spark):
    """Held-out accuracy: fitted on half of the labelled documents, tried on the other."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    model = quality.train(docs, labels.where(half == 0))
    got = quality.judge(docs, model).join(labels.where(half == 1), "doc_id").collect()
    right = [r.kept == (r.quality == 1) for r in got if not r.base_failed]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    assert all(r.kept for r in got if r.quality == 1 and not r.base_failed)


def test_leaks_of_documents(spark, given):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select(
        "item_id", "text").collect()]
    want = brute.leaks(given, [(str(i), t) for i, t in items])
    assert rows(queries.op10_decontamination(spark, SF)) == want
    assert any(v[4] for v in want.values())


@pytest.mark.parametrize("block", [1 << 20, 200, 40])
def test_leaks_of_odd_texts(spark, odd, block):
    items = [("a", " ".join(f"word{i}" for i in range(5, 25))), ("b", "AGAIN again"),
             ("c", "word40, word41; word42"), ("d", None), ("e", ""), ("f", "own"),
             ("g", " ".join(f"word{i}" for i in range(10, 22))), ("g2", "word41 word42")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.find_leaks(odd, bench, max_item_bytes=block)
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.hit_items), brute.sha(",".join(r.hit_items)),
                      r.n_hit > 0) for r in found.collect()}
    assert got == brute.leaks(ODD, items)
    clean = {r.doc_id: r.clean_text for r in found.collect()}
    assert clean[14].strip() == "" and clean[5] == "a" and "word7 " not in clean[12] + " "
    assert clean[12].startswith("before word0 word1 word2 word3 word4 word25")


def test_leaks_of_an_item_in_pieces(spark):
    words = [f"w{i}" for i in range(2 * decontamination.PIECE_WORDS + 40)]
    edge = decontamination.PIECE_WORDS
    for n in (0, 1, 9, 10, 11, edge, edge + 9, edge + 10, len(words)):
        pieces = [p.decode().split() for p in decontamination.item_pieces(" ".join(words[:n]), 10)]
        windows = [p[i:i + 10] for p in pieces for i in range(max(1, len(p) - 9))]
        assert windows == [words[:n][i:i + 10] for i in range(max(n - 9, min(n, 1)))]
    items = [("long", " ".join(words)), ("twin", " ".join(words[edge - 20:edge + 20]))]
    docs = [(i, " ".join(["x", *words[edge - 12 + i:edge - 2 + i], "y"])) for i in range(15)]
    docs += [(20, " ".join(words)), (21, " ".join(words[-9:]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("leak_mask", "LEAK_CARRIED", "hit_items")})
    found = decontamination.find_leaks(
        frame, spark.createDataFrame(items, "item_id string, text string"), max_item_bytes=9000)
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.hit_items), brute.sha(",".join(r.hit_items)),
                      r.n_hit > 0) for r in found.collect()}
    assert got == brute.leaks(docs, items)
    assert {(r.leak_mask, r.LEAK_CARRIED) for r in found.collect()} == {(7, 7)}
    assert set(found.columns) == {*frame.columns, "n_words", "n_hit", "over", "clean_text"}


@pytest.mark.parametrize("work", [
    line_dedup.dedup_lines,
    lambda d: sentence_pieces.encode(d, queries.piece_model()),
    lambda d: quality.judge(d, None),
    lambda d: decontamination.find_leaks(
        d, d.sparkSession.createDataFrame([("i", PLAIN)], "item_id string, text string")),
])
def test_empty_repeated_null_ids_and_clashing_columns(spark, work):
    assert work(spark.createDataFrame([], DOCS)).collect() == []
    twice = spark.createDataFrame(
        [(None, "some text", 1), (None, "some text", 1), (4, "some text", 1), (4, "else", 1)],
        "doc_id long, text string, n_words int")
    got = work(twice.withColumns({"kept": twice.text, "n_lines": twice.text})).collect()
    assert len(got) == 4 and [r.doc_id for r in got].count(None) == 2
    assert len(set(map(str, [r for r in got if r.doc_id is None]))) == 1


PLAIN = " ".join(f"plain{i}" for i in range(12))
