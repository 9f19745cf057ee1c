"""Sinks: the clip manifest and plain URL lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def temp_names(session: str = "session") -> dict:
    """Names of the intermediate files a renderer uses for one run."""
    key = F.col(session)
    return {
        "audio_file": F.concat(F.lit("audio_"), key, F.lit(".wav")),
        "clip_file": F.concat(F.lit("temp_clip_"), key, F.lit(".mp4")),
        "cropped_file": F.concat(F.lit("temp_cropped_"), key, F.lit(".mp4")),
        "subtitled_file": F.concat(F.lit("temp_subtitled_"), key, F.lit(".mp4")),
    }


def write_plan(
    plan: DataFrame, path: str, partition_by: Sequence[str] = ("status",), rows_per_file: int = 5_000_000
) -> None:
    """Write the manifest.  Overwriting makes a repeated run idempotent.

    Partition by columns with few values only; ``rows_per_file`` keeps the files
    of a very large partition at a readable size.
    """
    (
        plan.write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partition_by)
        .parquet(path)
    )


def update_plan(
    plan: DataFrame, path: str, run_id: str, partition_by: Sequence[str] = ("status",), rows_per_file: int = 5_000_000
) -> int:
    """Replace only the partitions that ``plan`` has rows for, marked with ``run_id``; the others stay.

    The rows are counted while they are written and again as they are read back; a difference raises.  A
    run that is repeated replaces its own partitions.  Returns the number of rows.
    """
    seen = Observation()
    marked = plan.withColumn("run_id", F.lit(run_id)).observe(seen, F.count(F.lit(1)).alias("n"))
    (
        marked.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partition_by)
        .parquet(path)
    )
    written = seen.get["n"]
    stored = read_plan(plan.sparkSession, path).where(F.col("run_id") == run_id).count()
    if stored < written:
        raise OSError(f"{written} rows of run {run_id} were written to {path}, {stored} are there")
    return written


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """The stored plan with the run that wrote each row."""
    return spark.read.parquet(path)


def export_channel(
    listing: DataFrame, tabs: Sequence[str] = ("videos", "streams", "shorts")
) -> DataFrame:
    """Distinct watch URLs over the wanted tabs of a channel."""
    return listing.where(F.col("tab").isin(*tabs)).select("url").dropDuplicates(["url"])


def write_channel(urls: DataFrame, path: str) -> None:
    """One URL per line, UTF-8, in the form ``read_items`` reads."""
    urls.select("url").write.mode("overwrite").text(path)
