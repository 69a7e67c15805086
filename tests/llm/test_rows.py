"""Token counts, personal data and license scans against plain versions."""
import hashlib
import re

import numpy as np
import pytest
from brute import ALNUM_WORDS, LOWER
from odd_rows import ODD, SF
from test_whole_contracts import rows

from emberledger.llm import boosting, licenses, personal_data, queries, token_counts


def test_counts_are_those_of_the_unigram_tokenizer(spark, given, odd):
    from tokenizers import Tokenizer, models

    pieces = token_counts.vocabulary(queries.piece_model())
    whole = Tokenizer(models.Unigram(pieces, 0, True))

    def plain(text):
        return len(whole.encode("▁" + text.replace(" ", "▁")).ids) if text else 0

    got = rows(queries.op6_token_counts(spark, SF))
    assert got == {d: (plain(t),) for d, t in given}
    got = rows(token_counts.count_tokens(odd, queries.piece_model()).drop("text"))
    assert got == {d: (plain((t or "").replace("▁", " ")),) for d, t in ODD}


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def luhn(d):
        d = [int(c) for c in d[::-1]]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                    or (kind == 2 and 12 <= len(digits) <= 19 and luhn(digits))
                    or (kind == 3 and 9 <= len(digits) <= 15)):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


PERSONAL = [
    "a@b.c, x.y+z@d-e.f.g. @no.where a@b a@@b.c d@e.f@g.h a@b.c.@x.y", "1.2.3.4.5.6.7.8 300.1.1.1",
    "0.0.0.0255 1.2.3.04 x1.2.3.4y 1..2.3.4.5", "4111 1111 1111 1111 and 12 4111-1111-1111-1111",
    "4111111111111112 4111  1111", "+1 (555) 010-9999 +12 +1 2 3 4 5 6 7 8 +()", "5 " * 40,
    "é+49 30 1234567é ünï@exä.de", "", "at [at] name [at] host.org", "٣٤ 1٣.2.3.4",
]


def test_base_spans_are_those_of_the_patterns(spark, given):
    for text in [*PERSONAL, *(t or "" for _, t in given), *(t or "" for _, t in ODD)]:
        assert personal_data.base_spans(text) == plain_spans(text), text
    got = rows(queries.op7_personal_data(spark, SF))
    for doc, text in given:
        base = plain_spans(text)
        counts = tuple(sum(k == kind for _b, k, _e in base) for kind in range(4))
        named = [f"{personal_data.KINDS[k]}:{b}:{e}" for b, k, e in base]
        assert got[doc][:5] == (*counts, hashlib.sha256(",".join(named).encode()).hexdigest())
        assert set(named) <= set(filter(None, got[doc][5].split(",")))


def test_trees_learn_and_add_what_the_patterns_reject(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    trees = personal_data.train(docs)
    held = docs.where("pmod(doc_id, 7) = 3 and text rlike '[0-9]{4}'").limit(300).collect()
    taught = [x for r in held for x in personal_data.lessons(r.text)]
    x, y = np.array([f for f, _ in taught]), np.array([v for _, v in taught])
    assert ((trees.probabilities(x) >= .5) == y).mean() > .97
    text = "number 12 4111111111111111 here"
    assert personal_data.base_spans(text) == []
    df = spark.createDataFrame([(1, text), (2, None), (3, "a@b.c")], "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.find(df, trees).collect()}
    assert got[1].n_card == 0 and got[2].redacted == "" and got[3].redacted == "[email]"
    assert got[3].spans == "email:0:5"


def test_boosting_separates_and_takes_constant_features():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    x[:, 3] = 1.0
    y = (x[:, 0] > .2) ^ (x[:, 1] > 0)
    trees = boosting.fit(x[:400], y[:400])
    assert ((trees.probabilities(x[400:]) > .5) == y[400:]).mean() > .9


def plain_licenses(text):
    """Names of the templates of which some stretch holds enough shingles."""
    w = ALNUM_WORDS.findall((text or "").translate(LOWER))
    n = licenses.SHINGLE
    have = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
    out = set()
    for name, template in licenses.TEMPLATES:
        t = ALNUM_WORDS.findall(template.translate(LOWER))
        own = {tuple(t[i:i + n]) for i in range(len(t) - n + 1)}
        size = len(t) - n + 1
        if any(len(own & set(have[i:i + size])) >= licenses.CONTAINMENT * len(own)
               for i in range(len(have))):
            out.add(name)
    return out


def test_licenses_are_those_of_all_stretches(spark, given):
    text = dict(licenses.TEMPLATES)
    fill = " ".join(f"f{i}" for i in range(50))
    made = [(1000 + i, f"{fill[:7 * i]} {t.upper()}\n{fill}") for i, t in enumerate(text.values())]
    made += [(2001, f"{text['GPL-3.0']} {text['GPL-3.0']} {text['MIT']}"), (2002, "Apache License"),
             (2003, text["LGPL-2.1"].replace("software", "hardware")),
             (2004, text["LGPL-2.1"].replace("free", "x").replace("terms", "y"))] + ODD
    df = spark.createDataFrame(made, "doc_id long, text string")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for docs, frame in ((made, df), ([tuple(r) for r in big.collect()], big)):
        got = {r.doc_id: r.licenses for r in licenses.scan(frame).collect()}
        assert {d: {x.license for x in v} for d, v in got.items()} == {
            d: plain_licenses(t) for d, t in docs}
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert [(x.license, x.begin, x.stop) for x in got[2001]] == [
        ("GPL-3.0", 0, 12), ("GPL-3.0", 12, 24), ("MIT", 24, 29)]
    assert licenses.miss_chance(0.25) < 2e-6
    assert sum(v[0] for v in rows(queries.op8_license_scans(spark, SF)).values()) > 0


@pytest.mark.parametrize("work", [
    lambda d: token_counts.count_tokens(d, queries.piece_model()),
    lambda d: personal_data.find(d, personal_data.train(d)), licenses.scan])
def test_no_rows_nulls_repeats_and_clashing_columns(spark, work):
    schema = "doc_id long, text string, n_tokens string, spans int, licenses string, n_ip string"
    assert work(spark.createDataFrame([], schema)).collect() == []
    row = (None, "Released under the MIT License. 1.2.3.4", "x", 1, "y", "z")
    got = work(spark.createDataFrame([row, row, (1, None, None, None, None, None)],
                                     schema)).collect()
    assert len(got) == 3 and got[0] == got[1] or got[1] == got[2]
