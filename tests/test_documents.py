"""Redaction, bills, delimited exports, registry."""
import csv
import hashlib
import io
import random
import re
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from emberledger import constants
from emberledger.operators import bills, cleansing, privacy
from emberledger.sources import bill_text, documents
from emberledger.sources.delimited import read_delimited


def supp(name):
    return "TOKEN_SUPP_" + hashlib.sha256(name.lower().encode()).hexdigest()[:10].upper()


def acct(raw):
    bare = re.sub(r"[\s\-]", "", raw).upper()
    return "TOKEN_ACCT_" + hashlib.sha256(bare.encode()).hexdigest()[:10].upper()


PGE, ACME = "Pacific Gas & Electric", "Acme Industrial Supplies LLC"
REDACTIONS = [
    ("Gas from Shell Energy North America and power from pacific gas & electric.",
     f"Gas from {supp('Shell Energy North America')} and power from {supp(PGE)}."),
    ("Monthly invoice. Account #: ACCT-9842-1104. Meter No: MTR-5544321. Billing Account: 123456789.",
     f"Monthly invoice. Account #: {acct('ACCT-9842-1104')}. Meter No: {acct('MTR-5544321')}. "
     f"Billing Account: {acct('123456789')}."),
    ("Delivered to Acme Industrial  Supplies LLC main depot, not Acmes.",
     f"Delivered to {supp(ACME)} main depot, not Acmes."),
    ("Account Summary\nAccount Status: Active\nAcct #: ACCT-11223344",
     f"Account Summary\nAccount Status: Active\nAcct #: {acct('ACCT-11223344')}"),
    ("Account: 12345\nUsage: 123450 kWh.\nBilled 12345 again",
     f"Account: {acct('12345')}\nUsage: 123450 kWh.\nBilled {acct('12345')} again"),
    ("Tax ID: 12-3456789\nEIN: 98-7654321\nVAT Number: GB123456789\nTIN: 555-66-7777\nTAX-99887766",
     f"Tax ID: {acct('12-3456789')}\nEIN: {acct('98-7654321')}\nVAT Number: {acct('GB123456789')}\n"
     f"TIN: {acct('555-66-7777')}\n{acct('TAX-99887766')}"),
    (f"Supplier: {supp('Acme Corp')}, Account: {acct('ACCT-9842-1104')}",
     f"Supplier: {supp('Acme Corp')}, Account: {acct('ACCT-9842-1104')}"),
    ("Cust ID: 9842-1104; Meter No.: 9842-1105; Acct. 9842-1106; Contract Account: 9842-1107",
     f"Cust ID: {acct('9842-1104')}; Meter No.: {acct('9842-1105')}; Acct. {acct('9842-1106')}; "
     f"Contract Account: {acct('9842-1107')}"),
    ("", ""), (None, ""),
]
NAMES = ["Shell Energy North America", PGE, "Acme", ACME, "Acme Corp", " ", "TOKEN_SUPP_X"]


@pytest.mark.parametrize("as_table", [False, True])
def test_redaction(spark, as_table):
    docs = spark.createDataFrame([(n, t) for n, (t, _e) in enumerate(REDACTIONS)],
                                 "doc_id int, body string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string") if as_table else NAMES
    done = privacy.redact(docs, "body", names)
    got = {r.doc_id: r.redacted_text for r in done.collect()}
    for n, (_text, expected) in enumerate(REDACTIONS):
        assert got[n] == expected
    pairs = {(r.doc_id, r.token, r.raw_value) for r in privacy.token_map(done).collect()}
    assert (2, supp(ACME), ACME) in pairs and (4, acct("12345"), "12345") in pairs
    assert not [p for p in pairs if p[0] == 6]


BILLS = [
    (["Pacific Gas & Electric\nAccount Number: 9842-1104\nBilling Period: 01/01/2025 - 01/31/2025\n"
      "Total Electricity Usage: 1,450.50 kWh\nTotal Charges: $215.40"],
     [("page:1,line:4", "electricity_purchase", "1450.50", "kWh", "US", date(2025, 1, 1),
       date(2025, 1, 31), supp(PGE), acct("9842-1104"))]),
    (["ConEdison\nInvoice Date: 2025-04-15\nUsage (kWh): 875.25\nCurrent Charges: $131.29"],
     [("page:1,line:3", "electricity_purchase", "875.25", "kWh", "US", date(2025, 4, 15),
       date(2025, 4, 15), supp("ConEdison"), None)]),
    (["National Grid\nService Dates: 03/01/2025 to 03/31/2025\nMeter 1 Gas Consumption: 85.5 CCF\n"
      "Plant Usage: 45 MMBtu"],
     [("page:1,line:3", "natural_gas_combustion", "85.5", "ccf", "US", date(2025, 3, 1),
       date(2025, 3, 31), supp("National Grid"), None),
      ("page:1,line:4", "natural_gas_combustion", "45", "MMBtu", "US", date(2025, 3, 1),
       date(2025, 3, 31), supp("National Grid"), None)]),
    (["Florida Power & Light\nBilling Period: January 1, 2025 through Jan 31st, 2025\n"
      "Electricity: 2,100 kWh @ $0.15 / kWh = $315",
      "Florida Power & Light - Operations\nGenerator: 350 therms\n"
      "Backup from 2025-02-01 to 2025-02-10: 150 gallons\nSan Francisco, CA 94105"],
     [("page:1,line:3", "electricity_purchase", "2100", "kWh", "CA", date(2025, 1, 1),
       date(2025, 1, 31), supp("Florida Power & Light"), None),
      ("page:2,line:2", "natural_gas_combustion", "350", "therms", "CA", date(2025, 1, 1),
       date(2025, 1, 31), supp("Florida Power & Light"), None),
      ("page:2,line:3", "freight_road", "150", "gallons", "CA", date(2025, 2, 1),
       date(2025, 2, 10), supp("Florida Power & Light"), None)]),
    (["Utility Provider: British Power Ltd\nElectricity: 1,000 kWh"],
     [("page:1,line:2", "electricity_purchase", "1000", "kWh", "US", date(2030, 1, 1),
       date(2030, 1, 1), supp("British Power Ltd Electricity"), None)]),
    (["Pacific Gas & Electric\nFee: $50.00\nTotal: $60 kWh per kWh"], []),
]


def test_bills(spark):
    docs = spark.createDataFrame([(n, p) for n, (p, _e) in enumerate(BILLS)],
                                 "doc_id int, pages array<string>")
    headed = bills.bill_header(docs, F.lit("2030-01-01").cast("date"))
    got = {}
    for r in bills.bill_lines(headed).orderBy("doc_id", "raw_line_ref", "reading_no").collect():
        got.setdefault(r.doc_id, []).append(
            (r.raw_line_ref, r.activity_type, r.quantity, r.unit, r.geography, r.period_start,
             r.period_end, r.supplier_ref, r.account_ref))
    for n, (_pages, expected) in enumerate(BILLS):
        assert got.get(n, []) == [(*e[:2], D(e[2]), *e[3:]) for e in expected], n


def _readings_by_spans(line):
    """Both patterns over the line, second matches dropped where they overlap first ones."""
    first = [(m.span(), m[1], m[2]) for m in re.finditer(constants.QTY_THEN_UNIT_PATTERN, line)]
    out = [(q, u) for _s, q, u in first]
    for m in re.finditer(constants.UNIT_THEN_QTY_PATTERN, line):
        if all(m.end() <= s or m.start() >= e for (s, e), _q, _u in first):
            out.append((m[2], m[1]))
    return [(D(q.replace(",", "")), u.lower()) for q, u in out]


def test_readings_against_brute_force(spark):
    rng = random.Random(7)
    pieces = ["12", "1,450.50", "$", "$ ", "kWh", "therms", "per ", "/", ":", " ", " = ", "(", ")",
              "gal", "tonne km", "USD ", "ccf", "-", "7", "Usage"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(ln,) for ln in lines], "line string")
    for r in df.select("line", bills.consumption_readings(F.col("line")).alias("r")).collect():
        assert [(x.quantity, x.spelling) for x in r.r] == _readings_by_spans(r.line), r.line


def test_longest_provider_wins_even_inside_another(spark):
    cases = {"bill of Shell Energy North America": "Shell Energy North America",
             "APS then arizona public service electric and gas": "public service electric and gas",
             "nothing here": None, "Vendor: Blue Fuel": "Blue Fuel"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.p for r in df.select("t", bills.detect_provider_name(F.col("t")).alias("p")).collect()}
    assert got == cases


def _write(folder, name, content):
    (folder / name).write_bytes(content)


def test_delimited_exports_of_many_layouts(spark, tmp_path):
    _write(tmp_path, "a.csv", b"\xef\xbb\xbfTxnID,Vendor,Fuel,Qty,UOM,Country,Date,End Date\n"
           b'TX-1,"Shell, ""Inc""",Natural Gas,"1,250.50",therms,GB,2025-01-01,2025-01-31\n'
           b",,,,,,,\n\nTX-2,,Electricity,bad,kWh,,15/02/2025\n")
    _write(tmp_path, "b.csv", "Fuel;Quantity;Unit;Date;Supplier\nPétrole;5;l;2025-03-01;É\n"
           .encode("latin-1"))
    _write(tmp_path, "c.csv", b"Fuel|Quantity|Unit|Date\nOil|(7)|l|45672\nOil||l|soon\n")
    _write(tmp_path, "d.csv", b"Fuel,Unit,Date\nOil,l,2025-01-01\n")
    _write(tmp_path, "e.csv", b"Fuel,Quantity,Unit,Date\n")
    read = read_delimited(spark, str(tmp_path))
    rows = {(r.document_id[-5], r.raw_line_ref): r for r in read.rows.collect()}
    assert len(rows) == 5
    tx1 = rows[("a", "TX-1")]
    assert (tx1.quantity, tx1.geography, tx1.period_end) == (D("1250.5"), "GB", date(2025, 1, 31))
    assert tx1.supplier_ref == supp('shell, "inc"') and tx1.row_errors == []
    tx2 = rows[("a", "TX-2")]
    assert tx2.row_errors == ["invalid quantity value"] and tx2.geography == "US"
    assert tx2.period_end == tx2.period_start == date(2025, 2, 15)
    b1 = rows[("b", "row:1")]
    assert b1.activity_type == "Pétrole" and b1.supplier_ref == supp("é")
    assert rows[("c", "row:1")].quantity == D("-7")
    assert rows[("c", "row:2")].row_errors == ["quantity cannot be empty", "invalid date value"]
    files = {r.document_id[-5]: r for r in read.files.collect()}
    assert files["d"].error == "Missing required column(s): quantity"
    assert files["e"].error.startswith("No data rows") and files["b"].delimiter == ";"
    outcome = {r.document_id[-5]: (r.status, r.rows_created)
               for r in cleansing.document_outcome(read.rows).collect()}
    assert outcome == {"a": ("failed", 0), "b": ("completed", 1), "c": ("failed", 0)}
    lenient = {r.document_id[-5]: (r.status, r.rows_created)
               for r in cleansing.document_outcome(read.rows, strict=False).collect()}
    assert lenient["a"] == ("completed", 1)
    good, bad = cleansing.split_quarantine(read.rows)
    assert (good.count(), bad.count()) == (3, 2)


def test_explicit_mapping_of_exports(spark, tmp_path):
    _write(tmp_path, "erp.csv", b"Transaction Date,Vendor Name,Activity Category,Consumption,UOM,"
           b"Facility Location,Invoice Number\n2025-01-15,Consolidated Edison,"
           b"electricity_purchase,14250.00,kWh,NY,INV-88901\n")
    read = read_delimited(spark, str(tmp_path), {"Activity Category": "activity_type"})
    r = read.rows.first()
    assert (r.activity_type, r.quantity, r.geography, r.raw_line_ref) == (
        "electricity_purchase", D("14250"), "NY", "INV-88901")
    lost = read_delimited(spark, str(tmp_path), {"activity_type": "No Such Column"})
    assert "activity_type" in lost.files.first().error and lost.rows.count() == 0


def test_registry_and_bill_files(spark, tmp_path):
    _write(tmp_path, "x.csv", b"abc")
    _write(tmp_path, "y.txt", b"Duke Energy\fpage two")
    docs = documents.register_folder(spark, str(tmp_path), "ent")
    one = docs.where("filename = 'x.csv'").first()
    digest = hashlib.sha256(b"abc").hexdigest()
    assert (one.file_hash_sha256, one.file_size_bytes, one.file_type) == (digest, 3, "csv")
    assert one.storage_path == f"documents/ent/{digest}/x.csv"
    assert documents.first_copies(docs.union(docs)).count() == 2
    assert documents.first_copies(docs, docs).count() == 0
    names = spark.createDataFrame([("../../a\\b.pdf", ".PDF"), ("..", "doc"), ("q.XLSX", None)],
                                  "n string, t string")
    got = [tuple(r) for r in names.select(
        documents.safe_name(F.col("n")), documents.file_type(F.col("n"), F.col("t"))).collect()]
    assert got == [("a_b.pdf", "pdf"), ("file", None), ("q.XLSX", "xlsx")]
    assert bill_text.read_bill_texts(spark, str(tmp_path / "y.txt")).first().pages == [
        "Duke Energy", "page two"]


def test_stray_quotes_lose_no_rows(spark, tmp_path):
    """A quote inside a cell is text; cells with line breaks go on over blocks of their file."""
    head = "Fuel,Quantity,Unit,Date,Line\n"
    plain = "".join(f"Oil,{i},l,2025-01-01,P{i}\n" for i in range(30))
    (tmp_path / "a.csv").write_text(head + 'Oil,1,l,2025-01-01,5" pipe\n' + plain)
    text, rng = head, random.Random(3)
    cells = ['5" pipe', '"two\nlines"', '"a ""b""\n,c\n"', '3" x 4"', '"z"', '"\n\n""q""\n"', "y",
             '"' + "long\n" * 60 + '"']
    for i in range(60):
        last = rng.choice(cells)
        last = f'{last[:-1]}-{i}"' if last.startswith('"') else f"{last}-{i}"
        text += f"{rng.choice(cells)},{i},l,2025-01-01,{last}\n"
    (tmp_path / "b.csv").write_text(text)
    (tmp_path / "c.csv").write_text(
        'Fuel;Quantity;Unit;Date;Line\nOil;1;l;2025-01-01;"x\ny"\nGas 5";2;l;2025-01-01;Z\n'
        'Oil;3;l;2025-01-01;"never\nclosed\n')
    want = [tuple(x.strip() for x in (r[0], r[4])) for r in csv.reader(io.StringIO(text))][1:]
    kept = {k: spark.conf.get(k) for k in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "3000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            rows = read_delimited(spark, str(tmp_path)).rows.collect()
            of = {n: [r for r in rows if r.document_id.endswith(n)] for n in ("a.csv", "b.csv", "c.csv")}
            assert {r.raw_line_ref for r in of["a.csv"]} == {'5" pipe', *(f"P{i}" for i in range(30))}
            assert sorted((r.activity_type, r.raw_line_ref) for r in of["b.csv"]) == sorted(want)
            assert sorted(int(r.quantity) for r in of["b.csv"]) == list(range(60))
            assert sorted(r.activity_type for r in of["c.csv"]) == ['Gas 5"', "Oil", "Oil"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
