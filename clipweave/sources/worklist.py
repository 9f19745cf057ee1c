"""Work lists: text files with one video URL or path per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipweave.functions import strip
from clipweave.operators.ordered import dense_index, position_chunk


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file as ``(line_no BIGINT, line STRING)``, 0-based.

    The file is read in splits like any other text.  A row's number is its place
    in its split plus the number of lines in earlier splits, so even a very long
    list is never read by one task.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = rows.groupBy("_file", "_start").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # One row per file split, whatever the number of lines.
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file",
        "_start",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return rows.join(offsets, ["_file", "_start"]).select(
        (F.col("_id") + F.col("_shift")).alias("line_no"), "line"
    )


def items_from_lines(lines: DataFrame) -> DataFrame:
    """Keep the stripped lines that are neither blank nor ``#`` comments."""
    item = strip("line")
    return lines.select("line_no", item.alias("item")).where(
        (F.col("item") != "") & ~F.col("item").startswith("#")
    )


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, item)``: order is ``line_no``, duplicates are kept."""
    return items_from_lines(read_lines(spark, path))


def preview_items(items: DataFrame) -> DataFrame:
    """Numbered listing over the kept lines: ``001. item``."""
    numbered = dense_index(items, [], position_chunk("line_no"), [F.col("line_no")], "_pos")
    return numbered.select(
        (F.col("_pos") + 1).alias("position"),
        F.format_string("%03d. %s", F.col("_pos") + 1, F.col("item")).alias("preview"),
    )


def list_files(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """``(path, length)`` of the files below a folder whose names match; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(folder).select("path", "length")
