"""Line dedup in DataFrame functions only.

Hashed line keys are dealt out by range over (key, salt) and sorted by document and position, so
that the first occurrence of a key in each document streams by; the slices of a key are then
summed. What comes back for a document is a sparse bitmap of its dropped lines, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberledger.llm.shared import stored, text_of

#: Slices of one key: documents that share it are dealt over as many groups.
SLICES = 64
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    key = F.btrim(line, F.lit(_BLANKS))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(
        F.translate(key, _UPPER, _LOWER))


def dropped_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, mark, dropped): for documents that lose lines, a map from block number to the 64
    bits of that block's lines, blocks without a dropped line left out. ``mark`` tells apart
    texts that share an id."""
    text = text_of(docs, text_col)
    lines = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("mark"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    ).withColumn("key", line_key("line")).where(F.char_length("key") >= min_chars)
    lines = stored(lines.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "mark",
        "pos", F.pmod(F.xxhash64("doc"), F.lit(SLICES)).alias("salt")), "lines")

    one = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("doc"), "mark", "pos")
    firsts = (
        lines.select("h1", "h2", "salt", "doc", "mark", "pos")
        .repartitionByRange("h1", "h2", "salt")
        .withColumn("nth", F.row_number().over(one))
        .withColumn("before", F.lag("doc").over(one))
        .where((F.col("nth") == 1) | ~F.col("before").eqNullSafe(F.col("doc")))
    )
    # Written out, so that the join below shuffles both sides anew and can split a hot key.
    frequent = stored(
        firsts.groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).drop("n_docs"), "frequent-lines")
    gone = lines.join(frequent, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    blocks = gone.groupBy("doc", "mark", F.floor(F.col("pos") / 64).alias("block")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return blocks.groupBy("doc", "mark").agg(
        F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The rows with ``line_text`` (the lines that stay), ``n_lines`` and ``n_dropped``.

    A key (see ``line_key``) of at least ``min_chars`` code points that is found in at least
    ``min_docs`` documents loses its lines in all documents but the one with the largest id.
    Null and empty texts are one empty line. Rows with equal ids count as one document; a null
    id is the smallest. Ties cannot arise: the largest id is unique. Columns named as the added
    ones give way.
    """
    marks = dropped_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    added = ("line_text", "n_lines", "n_dropped")
    rows = docs.select(*[c for c in docs.columns if c.lower() not in added])
    text = text_of(rows, text_col)
    rows = rows.select(F.struct("*").alias("row"), text.alias("whole"),
                       F.xxhash64(text).alias("of"))
    on = F.col(f"row.{id_col}").eqNullSafe(F.col("doc")) & (F.col("of") == F.col("mark"))
    split = "split(whole, '\\n', -1)"
    stays = ("(shiftright(coalesce(element_at(dropped, cast(i div 64 as bigint)), 0L), i % 64)"
             " & 1L) = 0")
    return rows.join(marks, on, "left").select(
        "row.*",
        F.when(F.col("dropped").isNull(), F.col("whole")).otherwise(
            F.expr(f"array_join(filter({split}, (x, i) -> {stays}), '\\n')")).alias("line_text"),
        F.size(F.expr(split)).cast("long").alias("n_lines"),
        F.coalesce(F.expr("aggregate(map_values(dropped), 0L, (a, b) -> a + bit_count(b))"),
                   F.lit(0)).cast("long").alias("n_dropped"),
    )
