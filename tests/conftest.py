import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from emberledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4",
                                        "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def table(spark):
    """Small DataFrame from rows of texts and a DDL schema, cast column by column."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    def build(rows, ddl):
        fields = [f.strip().rsplit(" ", 1) if "(" not in f else f.strip().split(" ", 1)
                  for f in _split(ddl)]
        text = T.StructType([T.StructField(n, T.StringType()) for n, _t in fields])
        data = [tuple(None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
                      for v in r) for r in rows]
        df = spark.createDataFrame(data, text)
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields])

    return build


def _split(ddl):
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
