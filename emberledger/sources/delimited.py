"""Delimited activity exports of any layout.

Files are read as lines, so large ones stay splittable, and any mix of layouts is read in one
job: delimiter, encoding and column mapping are found per file from its first lines and
joined to the lines of the file. A quote opens a cell only where the cell begins; elsewhere it
is text. In files with cells that are open where a line ends, lines are put together to records:
what a line does to the state is a map of it, and the maps are composed over the lines of each
block of a file and over its blocks, so that no file is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberledger.constants import DEFAULT_GEOGRAPHY, TARGET_FIELDS
from emberledger.functions.text import strip
from emberledger.operators.bounds import settled
from emberledger.operators.cleansing import build_activities, missing_fields, resolve_headers

DELIMITERS = (",", ";", "\t", "|")
_SAMPLE_LINES = 10
_CHUNK_BITS = 15


def cells_of(line: Column, delimiter: str) -> Column:
    """Cells of a line; a doubled quote inside a quoted cell stands for one."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    pattern = F.lit(rf'{d}(?:"([^"]*(?:""[^"]*)*)"|([^{d}]*))')
    led = F.concat(F.lit(delimiter), line)
    quoted = F.regexp_extract_all(led, pattern, F.lit(1))
    plain = F.regexp_extract_all(led, pattern, F.lit(2))
    return F.zip_with(
        quoted, plain,
        lambda q, p: strip(F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p)),
    )


def _cells_by_delimiter(line: Column, delimiter: Column) -> Column:
    chain = F
    for d in DELIMITERS[1:]:
        chain = chain.when(delimiter == d, cells_of(line, d))
    return chain.otherwise(cells_of(line, DELIMITERS[0]))


def _lines(spark: SparkSession, paths) -> DataFrame:
    """The lines, numbered as they lie (``_pos``) in blocks of their file: at most 32768 lines of
    one split, so that what goes block by block spreads however large the splits are."""
    return spark.read.text(paths).withColumn("_pos", F.monotonically_increasing_id()).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.struct(F.col("_metadata.file_block_start").alias("start"),
                 F.shiftright("_pos", _CHUNK_BITS).alias("chunk")).alias("_block"),
        "_pos", "value",
    )


#: The inside of a quoted cell, up to the quote that closes it or the end.
_INSIDE = '[^"]*+(?:""[^"]*+)*+'


def _opens(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a quoted cell is open at the end of a line that begins a record, and of one that
    begins inside a quoted cell."""
    d = "\\" + delimiter if delimiter == "|" else delimiter
    left_open = rf'(?:(?:"{_INSIDE}"[^{d}]*+|(?!")[^{d}]*+){d})*+"{_INSIDE}\z'
    return (F.rlike(line, F.lit(rf"\A{left_open}")),
            F.rlike(line, F.lit(rf'\A{_INSIDE}(?:"[^{d}]*+{d}{left_open}|\z)')))


def _sample_delimiters(lines: DataFrame) -> DataFrame:
    """(file_id, delimiter) from the first lines of each file, which every delimiter cuts into
    records of its own: the one of most records that have as many cells as the first."""
    first = Window.partitionBy("file_id").orderBy("_block", "_pos")
    text = lines.withColumn("_n", F.row_number().over(first)).where(
        F.col("_n") <= 5 * _SAMPLE_LINES).groupBy("file_id").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]),
            "\n").alias("_text"))

    def score(place: int, delimiter: str) -> Column:
        d = "\\" + delimiter if delimiter == "|" else delimiter
        cell = rf'(?:"{_INSIDE}(?:"[^{d}\n]*+|\z)|(?!")[^{d}\n]*+)'
        records = F.slice(F.filter(
            F.regexp_extract_all("_text", F.lit(f"{cell}(?:{d}{cell})*+"), F.lit(0)),
            lambda x: F.rlike(x, F.lit(r"\S"))), 1, _SAMPLE_LINES)
        counts = F.transform(records, lambda x: F.size(cells_of(x, delimiter)) - 1)
        head = F.get(counts, F.lit(0))
        agreeing = F.size(F.filter(counts, lambda c: c == head))
        return F.struct(
            F.when(head > 0, agreeing).otherwise(0).alias("agreeing"), head.alias("cells"),
            F.lit(-place).alias("place"), F.lit(delimiter).alias("delimiter"))

    scores = [score(i, d) for i, d in enumerate(DELIMITERS)]
    return text.select("file_id", F.array_max(F.array(*scores))["delimiter"].alias("_delimiter"))


def _composed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows with the composition of all maps (``_outer``, ``_inner``) up to each of them: the
    state that it ends in whatever it began with (``_fixed``), else whether it turns the state."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    turns = F.sum((F.col("_outer") & ~F.col("_inner")).cast("bigint")).over(so_far)
    fixes = F.when(F.col("_outer") == F.col("_inner"), F.struct("_outer", "_turns"))
    return rows.withColumn("_turns", turns).withColumn(
        "_last", F.last(fixes, ignorenulls=True).over(so_far)).withColumns({
            "_fixed": F.col("_last._outer")
            != ((F.col("_turns") - F.col("_last._turns")) % 2 == 1),
            "_turned": F.col("_turns") % 2 == 1}).drop("_turns", "_last", "_outer", "_inner")


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of files whose cells hold line breaks, which become line feeds. A cell that is
    never closed reaches to the end of its file."""
    lines = _lines(spark, paths)
    # A join by file would put each file into one task, and all that goes block by block with it.
    delimited = lines.join(F.broadcast(_sample_delimiters(lines)), "file_id")
    opens = {d: _opens(F.col("value"), d) for d in DELIMITERS}

    def chosen(side: int) -> Column:
        chain = F
        for d in DELIMITERS[1:]:
            chain = chain.when(F.col("_delimiter") == d, opens[d][side])
        return chain.otherwise(opens[DELIMITERS[0]][side])

    block = ["file_id", "_block"]
    in_block = Window.partitionBy(*block).orderBy("_pos")
    maps = _composed(delimited.select(
        *block, "_pos", "value", chosen(0).alias("_outer"), chosen(1).alias("_inner")),
        block, "_pos").withColumn("_prev", F.lag(F.struct("_fixed", "_turned")).over(in_block))

    def before(begun: bool) -> Column:
        """Whether a line begins inside a cell, if its block does or does not."""
        return F.when(F.col("_prev").isNull(), F.lit(begun)).otherwise(
            F.coalesce(F.col("_prev._fixed"), F.col("_prev._turned") != F.lit(begun)))

    # Both cases are counted in the pass that sorts the lines, which are settled: no later step
    # sorts them again or looks at their quotes.
    maps = settled(maps.withColumns({
        name: F.sum((~before(begun)).cast("bigint")).over(in_block)
        for name, begun in (("_nth_out", False), ("_nth_in", True))}), "export-lines")
    whole = maps.groupBy(*block).agg(
        F.max_by(F.struct("_fixed", "_turned"), "_pos").alias("_map"),
        F.max("_nth_out").alias("_nth_out"), F.max("_nth_in").alias("_nth_in")).select(
        *block, "_nth_out", "_nth_in", F.coalesce("_map._fixed", "_map._turned").alias("_outer"),
        F.coalesce(F.col("_map._fixed"), ~F.col("_map._turned")).alias("_inner"))
    by_block = Window.partitionBy("file_id").orderBy("_block")
    blocks = _composed(whole, ["file_id"], "_block").withColumn("_begun", F.coalesce(
        F.lag(F.coalesce("_fixed", "_turned")).over(by_block), F.lit(False)))
    starts = F.when(F.col("_begun"), F.col("_nth_in")).otherwise(F.col("_nth_out"))
    blocks = blocks.select(*block, "_begun", F.coalesce(F.sum(starts).over(by_block.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    stated = maps.join(F.broadcast(blocks), block).withColumns({
        "_after": F.coalesce(F.col("_fixed"), F.col("_begun") != F.col("_turned")),
        "_before": F.when(F.col("_begun"), before(True)).otherwise(before(False)),
        "_nth": F.when(F.col("_begun"), F.col("_nth_in")).otherwise(F.col("_nth_out"))})

    alone = stated.where(~F.col("_before") & ~F.col("_after"))
    parts = stated.where(F.col("_before") | F.col("_after"))
    joined = parts.groupBy(
        "file_id", (F.col("_nth") + F.col("_offset")).alias("_record")).agg(
        F.array_sort(F.collect_list(F.struct("_block", "_pos", "value"))).alias("_lines"))
    return alone.select(*block, "_pos", "value").unionByName(joined.select(
        "file_id", F.col("_lines")[0]["_block"].alias("_block"),
        F.col("_lines")[0]["_pos"].alias("_pos"),
        F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("value")))


def _rows(spark: SparkSession, paths) -> DataFrame:
    """Lines, and records of the files whose cells hold line breaks."""
    lines = _lines(spark, paths)
    left_open = F.lit(False)
    for d in DELIMITERS:
        left_open = left_open | _opens(F.col("value"), d)[0]
    broken = [r.file_id for r in lines.where(F.contains("value", F.lit('"')) & left_open).select(
        "file_id").distinct().collect()]
    if not broken:
        return lines
    return lines.where(~F.col("file_id").isin(broken)).unionByName(
        settled(_records(spark, broken), "export-records"))


def _decoded(value: Column, is_utf8: Column) -> Column:
    return F.when(is_utf8, value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1"))


def sniff(lines: DataFrame) -> DataFrame:
    """Per file: encoding, delimiter and header cells.

    The delimiter is the one that occurs equally often in most of the first ten non-blank
    lines (outside quotes), the comma if none does. Only those lines reach the shuffle.
    """
    utf8 = lines.groupBy("file_id").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("is_utf8")
    )
    first = Window.partitionBy("file_id").orderBy("_block", "_pos")
    sample = (
        lines.where(F.rlike("value", F.lit(r"\S")))
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= _SAMPLE_LINES)
    )
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counted = sample.withColumns(
        {
            f"_c{i}": F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))
            for i, d in enumerate(DELIMITERS)
        }
    )
    heads = counted.groupBy("file_id").agg(
        F.min_by(F.struct("value", "_block", "_pos"), "_n").alias("_head"),
        *[F.min_by(f"_c{i}", "_n").alias(f"_h{i}") for i in range(len(DELIMITERS))],
        *[F.collect_list(f"_c{i}").alias(f"_all{i}") for i in range(len(DELIMITERS))],
    )
    scores = F.array(
        *[
            F.struct(
                F.when(
                    F.col(f"_h{i}") > 0,
                    F.size(F.filter(F.col(f"_all{i}"), lambda c, h=F.col(f"_h{i}"): c == h)),
                ).otherwise(0).alias("agreeing"),
                F.col(f"_h{i}").alias("cells"),
                F.lit(-i).alias("place"),
                F.lit(d).alias("delimiter"),
            )
            for i, d in enumerate(DELIMITERS)
        ]
    )
    header = F.regexp_replace(
        _decoded(F.col("_head.value"), F.col("is_utf8")), "^\ufeff", ""
    )
    return (
        heads.join(utf8, "file_id")
        .withColumn("delimiter", F.array_max(scores)["delimiter"])
        .select(
            "file_id", "is_utf8", "delimiter", F.col("_head._block").alias("_hblock"),
            F.col("_head._pos").alias("_hpos"),
            _cells_by_delimiter(header, F.col("delimiter")).alias("header_cells"),
        )
    )


@dataclass(frozen=True)
class DelimitedRead:
    """``rows``: built rows with ``document_id`` and ``row_errors``. ``files``: one row per
    file that has lines, with its ``error`` (null when the layout is usable)."""

    rows: DataFrame
    files: DataFrame


def read_delimited(
    spark: SparkSession,
    paths,
    mapping: dict[str, str] | None = None,
    default_geography: str = DEFAULT_GEOGRAPHY,
) -> DelimitedRead:
    """Read activity exports; the path of a file is the id of its document."""
    lines = _rows(spark, paths)
    heads = sniff(lines)
    headers = heads.select(
        "file_id", F.posexplode("header_cells").alias("pos", "header")
    )
    resolved = resolve_headers(headers, mapping)
    explicit = [k if k in TARGET_FIELDS else v for k, v in (mapping or {}).items()]
    positions = resolved.groupBy("file_id").agg(
        *[F.max(F.when(F.col("target_field") == t, F.col("pos"))).alias(f"_p_{t}")
          for t in TARGET_FIELDS]
    )
    lacking = missing_fields(headers, resolved, explicit)
    layout = heads.join(positions, "file_id", "left").join(lacking, "file_id", "left")
    usable = layout.where(F.coalesce("missing_fields", F.lit("")) == "").drop(
        "missing_fields", "header_cells"
    )
    data = (
        lines.join(F.broadcast(usable), "file_id")
        .where((F.col("_block") > F.col("_hblock")) | (F.col("_pos") > F.col("_hpos")))
        .withColumn(
            "_cells",
            _cells_by_delimiter(_decoded(F.col("value"), F.col("is_utf8")), F.col("delimiter")),
        )
        .where(F.exists("_cells", lambda c: c != ""))
    )
    # Cut into cells once, for all that follows.
    data = settled(data.select(
        "file_id", "_block", "_pos", F.col("_p_raw_line_ref").isNull().alias("_unnamed"),
        *[F.get("_cells", F.col(f"_p_{t}")).alias(t) for t in TARGET_FIELDS]), "export-cells")
    # Only rows without a line reference of their own have to be counted.
    numbered = _number_rows(data.where("_unnamed")).unionByName(
        data.where(~F.col("_unnamed")).withColumns(
            {"_n": F.lit(None).cast("int"), "_offset": F.lit(None).cast("bigint"),
             "row_no": F.lit(None).cast("bigint")}))
    raw = numbered.select(F.col("file_id").alias("document_id"), "row_no", *TARGET_FIELDS)
    rows = build_activities(raw, default_geography, F.col("row_no"))
    counts = data.groupBy("file_id").agg(F.count(F.lit(1)).alias("data_rows"))
    files = layout.join(counts, "file_id", "left").select(
        F.col("file_id").alias("document_id"), "delimiter", "is_utf8",
        F.coalesce("data_rows", F.lit(0)).alias("data_rows"),
        F.when(
            F.coalesce("missing_fields", F.lit("")) != "",
            F.concat(F.lit("Missing required column(s): "), "missing_fields"),
        )
        .when(F.col("data_rows").isNull(), F.lit("No data rows found in tabular document."))
        .alias("error"),
    )
    return DelimitedRead(rows, files)


def identified(rows: DataFrame) -> DataFrame:
    """Rows with an ``activity_id`` of their document and all of their fields. Rows of a document
    that are equal throughout are told apart by a number; which is which makes no difference."""
    fields = [c for c in rows.columns if c not in ("document_id", "row_errors")]
    content = F.md5(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
    same = Window.partitionBy("document_id", "_content").orderBy("raw_line_ref")
    return rows.withColumn("_content", content).withColumn(
        "_nth", F.row_number().over(same)).select(
        F.md5(F.concat_ws("|", "document_id", "_content", "_nth")).alias("activity_id"),
        *rows.columns)


def _number_rows(data: DataFrame) -> DataFrame:
    """Ordinal of each row in its file, counted per block so that no file is one group."""
    per_block = data.groupBy("file_id", "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("file_id").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = per_block.select(
        "file_id", "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    in_block = Window.partitionBy("file_id", "_block").orderBy("_pos")
    return (
        data.withColumn("_n", F.row_number().over(in_block))
        .join(F.broadcast(offsets), ["file_id", "_block"])
        .withColumn("row_no", F.col("_n") + F.col("_offset"))
    )
