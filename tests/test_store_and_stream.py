"""Ledger storage and streaming: stored and streamed results equal batch results."""
import uuid

from pyspark.sql import functions as F

from emberledger.operators.emissions import compute
from emberledger.operators.classification import classify
from emberledger.operators.factors import FactorIndex
from emberledger.session import checkpoint_root
from emberledger.sources import ledger_store
from emberledger.sources.delimited import identified, read_delimited
from emberledger.sources.factor_tables import published_factors, read_factor_files
from emberledger.streaming import ingest

HEADERS = ["Line", "Fuel", "Quantity", "Unit", "Country", "Date"]


def _export(folder, name, rows):
    text = ",".join(HEADERS) + "\n" + "".join(",".join(r) + "\n" for r in rows)
    (folder / name).write_text(text)


FIRST = [("1", "electricity_purchase", "1000", "kWh", "US", "2025-01-15"),
         ("2", "natural_gas_combustion", "5", "MMBtu", "US", "2025-02-15"),
         ("3", "electricity_purchase", "2.5", "MWh", "US-CA", "2025-03-15")]
SECOND = [("4", "electricity_purchase", "x", "kWh", "US", "2025-01-15"),
          ("5", "business_travel_air", "300", "passenger.miles", "FR", "2025-04-15")]


def test_stream_equals_batch(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    index = FactorIndex.build(published_factors(spark))
    run = str(uuid.uuid4())

    rows_path = str(tmp_path / "rows")

    def stream():
        ingest.ingest_exports(
            spark, str(inbox), f"in-{run}",
            lambda rows, batch: rows.write.mode("append").parquet(rows_path),
            files_per_batch=1).awaitTermination()
        schema = spark.read.parquet(rows_path).schema
        arriving = spark.readStream.schema(schema).parquet(rows_path).withColumnRenamed(
            "document_id", "source_document_id")
        good = arriving.where(F.size("row_errors") == 0).withColumn("entity_id", F.lit("E"))
        done = ingest.calculated(good, index)
        ingest.append_available(done, out, f"rows-{run}").awaitTermination()
        totals = {}

        def keep(rows, _batch):
            for r in rows.collect():
                totals[(r.entity_id, r.reporting_year, r.scope)] = (r.total_tco2e, r.activity_count)

        ingest.upsert_available(
            ingest.running_scope_totals(done), f"totals-{run}", keep).awaitTermination()
        return totals

    _export(inbox, "a.csv", FIRST)
    first = stream()
    assert {k[2] for k in first} == {1, 2}
    _export(inbox, "b.csv", SECOND)
    second = stream()
    assert set(second) == {("E", 2025, 3)}  # only what changed is handed over

    read = read_delimited(spark, str(inbox))
    batch = compute(classify(read.rows.where(F.size("row_errors") == 0)
                             .withColumnRenamed("document_id", "source_document_id")
                             .withColumn("entity_id", F.lit("E"))
                             .withColumn("activity_id", F.col("raw_line_ref"))), index)
    cols = ["raw_line_ref", "activity_type", "scope", "status", "factor_id", "result_tco2e"]
    streamed = spark.read.parquet(out)
    assert sorted(streamed.select(cols).collect()) == sorted(batch.select(cols).collect())
    totals = {tuple(r)[:3]: tuple(r)[3:] for r in ingest.running_scope_totals(batch).collect()}
    assert totals == {**first, **second}


def test_streamed_rows_are_those_of_a_batch(spark, tmp_path):
    """Equal rows, rows that differ in supplier, place or end only, files without references."""
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    head = "Fuel,Quantity,Unit,Country,Date,End date,Supplier\n"
    line = "electricity_purchase,10,kWh,{},2025-01-15,{},{}\n"
    (inbox / "a.csv").write_text(head + line.format("US", "2025-01-31", "Acme")
                                 + line.format("GB", "2025-01-31", "Beta")
                                 + line.format("US", "2025-02-28", "Acme")
                                 + line.format("US", "2025-01-31", "Acme") * 2)
    (inbox / "b.csv").write_text("Line," + head + ("7," + line.format("US", "", "Acme")) * 3)
    (inbox / "c.csv").write_text(
        head + line.format("US", "", '"Acme, ""North""\nand sons"') + line.format("US", "", "B"))
    ingest.ingest_exports(spark, str(inbox), f"in-{uuid.uuid4()}", lambda rows, batch: (
        rows.write.mode("append").parquet(out)), files_per_batch=1).awaitTermination()
    streamed = spark.read.parquet(out)
    batch = identified(read_delimited(spark, str(inbox)).rows)
    got, want = (sorted(map(str, df.select(sorted(batch.columns)).collect()))
                 for df in (streamed, batch))
    assert got == want and len(got) == 10
    assert streamed.select("activity_id").distinct().count() == 10
    refs = {r.raw_line_ref for r in streamed.where("document_id like '%a.csv'").collect()}
    assert refs == {f"row:{n}" for n in range(1, 6)}
    assert streamed.where("size(row_errors) > 0").count() == 0
    names = streamed.where("document_id like '%c.csv'").select("supplier_ref").distinct()
    assert names.count() == 2


def test_store_prunes_and_replaces(spark, table, tmp_path):
    path = str(tmp_path / "ledger")
    ddl = "activity_id string, entity_id string, period_start date, result_tco2e decimal(20,8)"
    ledger_store.append(table([("a", "E", "2024-05-01", "1"), ("b", "E", "2025-05-01", "2"),
                               ("c", "F", "2025-05-01", "3")], ddl), path)
    ledger_store.replace_rows(
        spark, table([("b", "E", "2025-05-01", "20"), ("d", "E", "2025-06-01", "4")], ddl), path,
        "activity_id")
    rows = {r.activity_id: int(r.result_tco2e) for r in ledger_store.scan(spark, path).collect()}
    assert rows == {"a": 1, "b": 20, "c": 3, "d": 4}
    ledger_store.replace_rows(  # rows that move to another year or entity leave nothing behind
        spark, table([("a", "E", "2025-07-01", "10"), ("c", "G", "2025-05-01", "30")], ddl), path,
        "activity_id")
    rows = sorted((r.activity_id, r.entity_id, int(r.result_tco2e))
                  for r in ledger_store.scan(spark, path).collect())
    assert rows == [("a", "E", 10), ("b", "E", 20), ("c", "G", 30), ("d", "E", 4)]
    ledger_store.replace_rows(
        spark, table([("a", "E", "2024-05-01", "1")], ddl), path, "activity_id")
    one = ledger_store.scan(spark, path, entity_id="E", year=2025)
    assert {r.activity_id for r in one.collect()} == {"b", "d"}
    plan = one._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(period_year" in plan


def test_factor_files_keep_digits(spark, tmp_path):
    (tmp_path / "f.json").write_text(
        '[{"source": "X", "source_version": "1", "activity_type": "a", "geography": "US", '
        '"unit": "kWh", "factor_value": "0.12345678", "factor_unit": "kg/kWh", '
        '"published_date": "2025-01-01", "effective_from": "2025-01-01", "effective_to": null}]')
    row = read_factor_files(spark, str(tmp_path / "f.json")).first()
    assert str(row.factor_value) == "0.12345678" and row.effective_to is None


def test_checkpoint_folder_comes_from_the_session(spark):
    first = checkpoint_root(spark)
    assert first == checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
