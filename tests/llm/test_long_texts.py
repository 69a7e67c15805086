"""Texts beyond a step, and words that weak fingerprints would take for each other."""
import brute
import numpy as np
import pyarrow as pa
import pytest
from odd_rows import SF

from emberledger.llm import (
    decontamination, near_duplicates, quality, recompression, sentence_pieces, suffix_dedup,
    queries,
)
from emberledger.llm.tokens import Sums, Texts, Words, fingerprints

ONE = "a"
for _ in range(12):
    ONE += ONE.translate(str.maketrans("ab", "ba"))
TWO = ONE.translate(str.maketrans("ab", "ba"))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def rows(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_thue_morse_words_differ_everywhere(spark):
    words = Words(Texts.of(pa.array([f"{ONE} {TWO} {ONE}"])))
    assert words.keys[0] == words.keys[2] != words.keys[1]
    counts = quality.base_counts(Words(Texts.of(pa.array([f"{ONE}\n{TWO}\n{ONE}"]))))
    assert counts["n_dup_lines"].tolist() == [1]
    sets, ranges = near_duplicates.shingle_sets(pa.array([f"x y z {ONE}", f"x y z {TWO}"]), 4)
    assert ranges.tolist() == [0, 1, 2] and sets[0] != sets[1]
    docs = [(1, f"{ONE} " * 25), (2, f"{TWO} " * 25), (3, f"{TWO} " * 21)]
    assert rows(recompression.digest(frame(spark, docs))) == brute.repeated_words(docs)
    assert rows(suffix_dedup.digest(frame(spark, docs[:2]))) == brute.repeated_bytes(docs[:2])
    items = spark.createDataFrame([("i", f"{ONE} tail")], "item_id string, text string")
    got = decontamination.find_leaks(frame(spark, [(1, f"{TWO} tail"), (2, f"{ONE} tail")]), items)
    assert {r.doc_id: r.n_hit for r in got.collect()} == {1: 0, 2: 2}


def test_fingerprints_across_blocks_are_those_of_the_bytes():
    data = np.random.default_rng(5).integers(0, 256, 30_000).astype(np.uint8)
    again = np.concatenate((data[:7], data))
    begins = np.array([0, 4095, 4096, 5000, 8191, 0, 29_999, 17])
    ends = np.array([30_000, 4097, 8192, 25_000, 20_000, 0, 30_000, 4096])
    assert (fingerprints(Sums(data), begins, ends)
            == fingerprints(Sums(again), begins + 7, ends + 7)).all()


def test_long_texts_as_short_ones(spark):
    """Operators that look at a text as a whole, over one of several steps' length."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in rng.integers(0, 40_000, 260_000)]
    words[9_000:9_400] = words[130_900:131_300]  # across the end of a stretch of words
    long = " ".join(words[:150_000]) + "\n" + "y" * 300_000 + "\n" + " ".join(words[150_000:])
    docs = [(1, long), (2, "short words " * 30), (3, None)]
    df = frame(spark, docs)
    assert rows(recompression.digest(df)) == brute.repeated_words(docs)
    base = quality.judge(df, None).drop("text", "p_good", "kept")
    assert rows(base) == brute.quality_base(docs)
    model = queries.piece_model()
    assert rows(sentence_pieces.digest(df, model).drop("text")) == brute.sentence_pieces(docs, model)
    assert rows(near_duplicates.near_groups(df)) == brute.near_classes(docs)


def test_a_passage_across_a_stretch_of_bytes_is_removed(spark):
    rng = np.random.default_rng(7)
    letters = rng.integers(97, 123, 2_400_000).astype(np.uint8)
    passage, edge = letters[:3000].tobytes(), suffix_dedup._STRETCH
    text = bytearray(letters[3000:].tobytes())
    for at in (5_000, edge - 1_500):  # between signs that differ, so that it cannot grow
        text[at - 1:at + 3001] = b"<" + passage + b">" if at > 5_000 else b"(" + passage + b")"
    kept = bytes(text[:5_000] + text[8_000:edge - 1_500] + text[edge + 1_500:])
    got = rows(suffix_dedup.digest(frame(spark, [(1, text.decode())])))
    assert got == {1: (len(text), 6000, 2, brute.sha(kept))}


@pytest.mark.parametrize("work", [suffix_dedup.digest, recompression.digest])
def test_many_rows_without_ids_are_told_apart(spark, work):
    rows_ = spark.range(100_000).selectExpr(
        "cast(null as long) as doc_id",
        "concat_ws(' ', transform(sequence(0, 24), i -> concat('t', id, 'n', i))) as text")
    got = work(rows_).selectExpr("count(*)", "count(distinct kept_sha256)", "sum(n_removed)")
    assert tuple(got.first()) == (100_000, 100_000, 0)


def test_queries_are_registered_once_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and SF
