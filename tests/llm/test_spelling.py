"""Spelling variants against a plain version."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import LOWER
from odd_rows import ODD, SF

from emberledger.llm import queries, spelling

RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def plain(docs, least=5, min_count=3):
    counts = Counter()
    for doc, text in docs:
        for word in RUNS.findall(text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if h % 97 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= min_count}
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].add(w)
            if (less := w[:i] + w[i + 1:]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=(0, None))
        form[w] = best[1] if -best[0] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def found(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_over_documents(spark, given):
    assert found(queries.op12_spelling_variants(spark, SF)) == plain(given)


def edited(seed, n=1200):
    """Documents of few words with many edits, anagrams, accents and very long words."""
    rng = random.Random(seed)
    letters = "abcé÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    words += ["z" * 300, "z" * 301, "z" * 299 + "y", "ABcdeFG", "abcdefh", "ÀÀÀÀÀ", "àÀÀÀÀ"]
    docs = []
    for doc in range(n):
        text = []
        for _ in range(rng.randrange(30)):
            w = list(rng.choice(words))
            for _ in range(rng.choice([0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
            text.append("".join(w))
        docs.append((doc, rng.choice([" ", "-", "1", "\n"]).join(text)))
    return docs


@pytest.mark.parametrize("cell_words", [16_384, 12])
def test_cells_of_any_size_find_the_same(spark, monkeypatch, cell_words):
    docs = edited(1) + [(1000 + d, t) for d, t in ODD] + [(2000 + d, t) for d, t in ODD * 2]
    monkeypatch.setattr(spelling.fit_cells, "__defaults__",
                        (spelling.SAMPLE_WORDS, cell_words))
    got = found(spelling.group_variants(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4)))
    want = plain(docs)
    assert got == want and sum(v[3] for v in want.values()) > 300


def test_checksums_are_those_of_the_library():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    begins = rng.integers(0, 4000, 300)
    ends = begins + rng.integers(0, 120, 300)
    before = rng.integers(0, 1 << 32, 300).astype(np.uint32)
    got = spelling.checksums(data, begins, ends, before)
    assert got.tolist() == [zlib.crc32(data[b:e].tobytes(), int(s))
                            for b, e, s in zip(begins, ends, before)]


def test_no_rows_nulls_repeats_long_texts_and_clashing_columns(spark):
    schema = "doc_id long, text string, word int, n string, form string"
    assert spelling.group_variants(spark.createDataFrame([], schema)).collect() == []
    long = "letter lettre " * 100_000 + "q" * 400_000
    docs = [(None, "common common commons"), (3, long), (3, long), (4, None), (5, "commons " * 2)]
    got = found(spelling.group_variants(spark.createDataFrame(
        [(d, t, 1, "x", "y") for d, t in docs], schema)))
    assert got == plain([("" if d is None else d, t) for d, t in docs])
