"""Records of exports across the blocks that their lines are dealt in."""
import csv
import random

import pytest
from pyspark.sql import functions as F

from emberledger.functions import dates, numbers
from emberledger.sources import delimited


@pytest.mark.parametrize("bits", [1, 3])
def test_records_reach_over_blocks_of_lines(spark, tmp_path, monkeypatch, bits):
    rng, head = random.Random(bits), ["Fuel", "Quantity", "Unit", "Country", "Date", "Supplier"]
    rows = [["gas", str(n), "kWh", "US", "2024-05-01", rng.choice(
        [f"Firm {n}", f'Firm "{n}"\nand sons', f"A\n\n{n}\n", f'5" pipe {n}'])] for n in range(60)]
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([head, *rows])
    monkeypatch.setattr(delimited, "_CHUNK_BITS", bits)
    lines = delimited._lines(spark, str(tmp_path))
    assert lines.select("_block").distinct().count() > 60 >> bits
    got = delimited.read_delimited(spark, str(tmp_path)).rows.collect()
    assert sorted((int(r.raw_line_ref[4:]), int(r.quantity)) for r in got) == [
        (n + 1, n) for n in range(60)]


def test_common_spellings_take_the_short_way_to_the_same_value(spark):
    texts = ["2024-05-01", "2024-13-05", "2024-02-30", "0000-01-01", "9999-12-31", "2024-5-1", "10",
             "1.1234567", "00012.5", "99999999999999", "123456789012345", "1.", ".5", "1,000", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select(
            "t", dates.parse_date(t).cast("string").alias("d"),
            dates._read(t, 2025).cast("string").alias("d_long"),
            numbers.parse_quantity(t).alias("q"), numbers._read(t).alias("q_long")).collect():
        assert (r.d, r.q) == (r.d_long, r.q_long), r.t
