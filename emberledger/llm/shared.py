"""Helpers of the corpus operators: shared storage, row passes over Arrow batches, column names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import emberledger
from emberledger.session import checkpoint_root

#: Text bytes that one numpy step works on; a longer document is a step of its own.
STEP_BYTES = 256 << 10
#: Bytes of an Arrow batch between the JVM and Python, at most (a longer row is one of its own);
#: by default Spark counts rows only, however wide they are.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage is cut, and the loss of
    an executor costs no more than the step at hand."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on executors that were started without it, once for each
    application, as ``--py-files`` does, and bounds the Arrow batches of the session in bytes,
    where it does not say itself how large they may be."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    if _SHIPPED.get("to") != context.applicationId:
        root = Path(emberledger.__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / "emberledger-code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED["to"] = context.applicationId
    return spark


_SHIPPED: dict[str, str] = {}


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The document's text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def extended(schema: T.StructType, added: str) -> T.StructType:
    """The schema with the added columns at its end; columns of the same names give way."""
    new = T.StructType.fromDDL(added)
    names = {f.name.lower() for f in new.fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + new.fields)


def steps(batches: Iterator[pa.RecordBatch], text: str,
          limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(batch.schema.get_field_index(text)).fill_null("")
        sizes = pc.binary_length(lengths).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(size)
        yield batch.slice(begin)


def add_columns(docs: DataFrame, text: str, added: str,
                make: Callable[[], Callable[..., list[pa.Array]]], *more: str,
                spent: tuple[str, ...] = ()) -> DataFrame:
    """The rows with further columns computed from the text, in Arrow batches without a shuffle.

    ``make`` is called once in each task and gives the function from a text array, and those of
    the columns named in ``more``, to the arrays of the added columns. ``spent`` columns do not
    come back.
    """
    schema = T.StructType([f for f in extended(docs.schema, added) if f.name not in spent])
    keep = [f.name for f in schema.fields[:len(schema.fields) - len(T.StructType.fromDDL(added))]]
    names = [*keep, *(f.name for f in T.StructType.fromDDL(added))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in steps(batches, text):
            columns = {n: part.column(i) for i, n in enumerate(part.schema.names)}
            made = work(columns[text].fill_null(""), *(columns[n] for n in more))
            yield pa.RecordBatch.from_arrays([*(columns[n] for n in keep), *made], names=names)

    return docs.mapInArrow(run, schema)
