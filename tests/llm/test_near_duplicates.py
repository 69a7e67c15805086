"""Near-duplicate groups against a plain version."""
import random

import brute
import pytest
from odd_rows import ODD, SF

from emberledger.llm import near_duplicates, queries
from emberledger.llm.components import components


def rows(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def edited(seed, copies, words, most_edits):
    """Copies of one text with a few words changed: some link, some only through others."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(most_edits + 1)):
            text[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(text[rng.randrange(3):]))
    return out


def test_groups_of_documents(spark, given):
    assert rows(queries.op9_ngram_jaccard_join(spark, SF)) == brute.near_classes(given)


def test_groups_of_odd_and_edited_texts(spark):
    texts = [t for seed, (copies, words, edits) in enumerate(
        [(40, 60, 4), (30, 150, 7), (12, 9, 1), (12, 14, 1), (20, 400, 25), (25, 30, 2)])
        for t in edited(seed, copies, words, edits)]
    docs = ODD + [(100 + 7 * i % 991, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute.near_classes(docs)
    assert rows(near_duplicates.near_groups(df)) == want
    sizes = [c for _n, c in want.values()]
    assert len(set(sizes)) > 12 and max(map(sizes.count, sizes)) > 10


def test_no_rows_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string, n long"
    assert near_duplicates.near_groups(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e", 1), (None, "z", 1), (5, "A b c d e", 1),
                                  (5, "A b c d e", 1), (7, "z", 1), (8, None, 2)], schema)
    got = sorted(map(tuple, near_duplicates.near_groups(docs).collect()), key=str)
    assert got == [(5, 2, 5), (5, 2, 5), (7, 1, 5), (8, 0, 8), (None, 1, 5), (None, 2, 5)]


@pytest.mark.parametrize("links, want", [
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(9, 3), (3, 9), (5, 9), (7, 7), (20, 10)], {9: 3, 3: 3, 5: 3, 7: 7, 20: 10, 10: 10}),
    ([], {}),
])
def test_components(spark, links, want):
    assert rows(components(spark.createDataFrame(links, "a long, b long"))) == {
        k: (v,) for k, v in want.items()}
