"""The trie of names against plain search, and redaction with a dictionary cut into tables."""
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberledger.functions.text import matches_of, regex_parts, substituted
from emberledger.operators import names, privacy

LETTERS = "abAB &é  ß界İ"


def _plain(text):
    folded = "".join(map(chr, names._folded(text or "")))
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return folded


@pytest.mark.parametrize("lane", [16, 2048])
def test_trie_finds_what_a_plain_search_finds(monkeypatch, lane):
    monkeypatch.setattr(names, "_LANE", lane)
    for seed in range(30):
        r = random.Random(seed)
        found = {"".join(r.choice(LETTERS) for _ in range(r.randint(1, 6))).strip()
                 for _ in range(40)} - {""}
        ordered = sorted(found, key=lambda n: (-len(n), n))
        trie = names.NameTable.build(pa.array(
            [dict(name_length=len(n), name=n, token="", pattern="") for n in ordered],
            names._ENTRY_TYPE))
        texts = ["".join(r.choice(LETTERS + "xyz") for _ in range(r.choice([0, 3, 50, 400])))
                 for _ in range(20)] + [None]
        owner, entry = trie.find(texts)
        assert list(zip(owner.tolist(), entry.tolist(), strict=True)) == [
            (i, j) for i, t in enumerate(texts) for j, n in enumerate(ordered)
            if _plain(n) in _plain(t)]


def test_more_characters_than_classes_lose_no_name():
    many = [chr(0x4E00 + n) + chr(0x4F00 + n) for n in range(300)]
    trie = names.NameTable.build(pa.array(
        [dict(name_length=2, name=n, token="", pattern="") for n in many], names._ENTRY_TYPE))
    owner, entry = trie.find(many)
    assert {(n, n) for n in range(300)} <= set(zip(owner.tolist(), entry.tolist(), strict=True))


def test_a_cut_dictionary_redacts_alike(spark, monkeypatch):
    depots = [(f"Depot {n} Nord",) for n in range(60)] + [(f"Depot {n}",) for n in range(60)]
    dictionary = spark.createDataFrame(depots, "name string")
    docs = spark.createDataFrame(
        [(n, f"at DEPOT  {n % 70} nord, depot {n % 7}\u0001 and Depot 1234. ACCT-{n}1234") for n
         in range(100)] + [(None, "depot 3 nord"), (7, None), (8, "")], "doc_id int, body string")

    def rows():
        done = privacy.redact(docs, "body", dictionary)
        return sorted(map(str, done.collect()))

    whole = rows()
    monkeypatch.setattr(names, "TABLE_CHARS", 300)
    assert len(list(names._tables(privacy.supplier_dictionary(dictionary)))) > 3
    assert rows() == whole
    assert not [r for r in whole if "nord" in r.split("redacted_text")[1].lower().split(
        "redactions")[0] and "doc_id=None" in r]


def test_no_names(spark):
    docs = spark.createDataFrame([(1, "Depot 1")], "doc_id int, body string")
    for none in ([], [" "], ["TOKEN_SUPP_1"]):
        assert privacy.redact(docs, "body", none).first().redacted_text == "Depot 1"


def test_parts_of_a_text_with_marks_in_it(spark):
    df = spark.createDataFrame([("a1b22",), ("1\u0001 2",), ("",), ("x",)], "t string")
    parts = regex_parts(F.col("t"), r"\d+")
    got = df.select(matches_of(parts), substituted(parts, lambda m: F.concat(F.lit("<"), m, F.lit(">"))))
    assert [tuple(r) for r in got.collect()] == [
        (["1", "22"], "a<1>b<22>"), (["1", "2"], "<1>\u0001 <2>"), ([], ""), ([], "x")]


def test_the_largest_of_our_dictionaries_is_one_table_and_one_pass(spark):
    """60,000 names that begin alike were eighteen tables, each with a pass over the texts."""
    dictionary = spark.range(60000).selectExpr("format_string('Supplier#%09d', id) as name")
    (table,) = names._tables(privacy.supplier_dictionary(dictionary))
    owner, entry = table.find(["to SUPPLIER#000059999, supplier#00000001", None,
                               "Supplier#000000007Supplier#000060000 supplier#000000007"])
    assert list(zip(owner.tolist(), table.entries.field("name").take(
        pa.array(entry)).to_pylist(), strict=True)) == [
        (0, "Supplier#000059999"), (2, "Supplier#000000007")]
    # Forty bytes a name, beside the entries.
    held = [table.hashes, table.order, *[a for h in table.heads for a in (
        h.hashes, h.first, h.lengths)]]
    assert sum(a.nbytes for a in held) < 45 * 60000
    docs = spark.createDataFrame([(1, "at supplier#000012345.")], "doc_id int, body string")
    plan = privacy.redact(docs, "body", dictionary)
    assert plan._jdf.queryExecution().executedPlan().toString().count("+- ArrowEvalPython") == 1
    assert [r.raw_value for r in plan.first().redactions] == ["Supplier#000012345"]


@pytest.mark.parametrize("lane", [16, 1 << 20])
def test_names_of_many_lengths_and_long_texts(monkeypatch, lane):
    """Names that are heads of each other, across the pieces a text is hashed and folded in."""
    monkeypatch.setattr(names, "_LANE", lane)
    ordered = sorted({"ab" * n for n in range(1, 30)} | {"Straße 1", "x y", "y"},
                     key=lambda n: (-len(n), n))
    table = names.NameTable.build(pa.array(
        [dict(name_length=len(n), name=n, token="", pattern="") for n in ["", *ordered]],
        names._ENTRY_TYPE))
    long = "-" * ((1 << 20) - 2) + "X \t\n Y" + "-" * 50
    texts = ["zAB" + "ab" * 12, "", "straße  1 x  y", "x", "y", *([long] if lane > 16 else [])]
    owner, entry = table.find(texts)
    assert list(zip(owner.tolist(), entry.tolist(), strict=True)) == [
        (i, j + 1) for i, t in enumerate(texts) for j, n in enumerate(ordered)
        if _plain(n) in _plain(t)]
