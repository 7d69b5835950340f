"""Readers for the raw films, title files, indicators and events."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from eraframe import schemas
from eraframe.constants import CURATED_EVENTS


def constant_table(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    """A literal table the optimizer knows the exact size of."""
    columns = list(zip(*rows, strict=True))
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(
        pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    )


def source_order() -> Column:
    """Position of a row in its source: file, block, then row within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_films(
    spark: SparkSession, path: str, schema=schemas.RAW_FILMS, multi_line: bool = True
) -> DataFrame:
    """Film CSV with quoted text that may span lines, plus ``seq``, its order.

    Files are read in parallel, but one file with multi-line text cannot be
    split. Turn ``multi_line`` off for large files known to hold none.
    """
    films = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    reals = [f.name for f in schema if f.dataType.typeName() == "double"]
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in reals}
    return films.select(
        source_order().alias("seq"), *[known.get(c, F.col(c)).alias(c) for c in films.columns]
    )


def _sum_before(lines: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``, the sum of ``value`` over all lines of the file before a line, and
    ``line_no``, the lines before it in its block.

    Blocks are summed first, so a window holds the blocks of a file or the lines of a block.
    """
    blocks_before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = F.coalesce(F.sum("in_block").over(blocks_before), F.lit(0))
    blocks = (
        lines.groupBy("file", "block")
        .agg(F.sum(value).alias("in_block"))
        .select(
            F.col("file").alias("own_file"), F.col("block").alias("own_block"), earlier.alias("earlier")
        )
    )
    same = (F.col("file") == F.col("own_file")) & (F.col("block") == F.col("own_block"))
    before = Window.partitionBy("file", "block").orderBy("row").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        lines.join(blocks, same)
        .withColumns(
            {
                name: F.col("earlier") + F.coalesce(F.sum(value).over(before), F.lit(0)),
                "line_no": F.count(F.lit(1)).over(before),
            }
        )
        .drop("own_file", "own_block", "earlier")
    )


def read_films_split(
    spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_FILMS
) -> DataFrame:
    """:func:`read_films` for large files: blocks of a file are parsed side by side.

    A line lies inside a quoted text if an odd number of quotes stands before it in its file. These
    numbers are summed up per block, then along the lines of each block. Most lines are records;
    only those of records over several lines are put together. Line ends inside quoted text
    are kept as they are; blank lines are left out, and a file's first line is its header.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(source_order().alias("seq"), "value", (quotes % 2).alias("odd"))
        .select("*", "seq.file", "seq.block", "seq.row")
    )
    placed = _sum_before(lines, "odd", "odd_before").withColumns(
        {
            "starts": F.col("odd_before") % 2 == 0,
            "ends": ((F.col("odd_before") + F.col("odd")) % 2 == 0).cast("int"),
        }
    )
    placed = placed.filter((F.col("block") > 0) | (F.col("line_no") > 0))
    whole = F.col("starts") & (F.col("ends") == 1)
    pieces = _sum_before(placed.filter(~whole), "ends", "record")
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    joined = pieces.groupBy("file", "record").agg(
        F.min("seq").alias("seq"),
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"),
    )
    records = placed.filter(whole).select("seq", "value").unionByName(joined.select("seq", "value"))
    text = F.regexp_replace("value", r"\r\z", "")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    options = {"quote": '"', "escape": '"', "header": "false"}
    films = records.filter(F.trim(text) != "").select("seq", F.from_csv(text, ddl, options).alias("film"))
    return _known_reals(films.select("seq", "film.*"), schema)


def _known_reals(films: DataFrame, schema: T.StructType) -> DataFrame:
    """Films with reals that are no number as null."""
    reals = [f.name for f in schema if f.dataType.typeName() == "double"]
    return films.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in reals})


def read_titles(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    r"""Title TSV as text columns; large files are split over tasks by line.

    Quotes have no meaning, ``\N`` and empty fields are null, short lines are
    padded with nulls. Lines with too many fields, blank lines and header lines
    are left out.
    """
    kept = "malformed"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, kept)])
    lines = (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("quote", "")
        .option("nullValue", "\\N")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", kept)
        .option("columnPruning", False)
        .csv(path)
    )
    # The reader keeps the text of lines that are too short or too long.
    tabs = F.length(kept) - F.length(F.replace(F.col(kept), F.lit("\t"), F.lit("")))
    fits = F.col(kept).isNull() | (tabs < len(columns))
    header = F.col(columns[0]).eqNullSafe(columns[0])
    return lines.filter(fits & ~header).drop(kept)


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Landed indicator series as CSV: ``indicator, year, value``."""
    return spark.read.schema(schemas.INDICATORS).option("header", True).csv(path)


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """Enriched macro CSV plus ``seq``, its order."""
    macro = spark.read.schema(schemas.MACRO).option("header", True).csv(path)
    return macro.select(source_order().alias("seq"), *macro.columns)


def curated_events(spark: SparkSession) -> DataFrame:
    """The curated events; ``seq`` is their priority."""
    rows = [(seq, *event) for seq, event in enumerate(CURATED_EVENTS, start=1)]
    return constant_table(spark, rows, schemas.EVENTS)
