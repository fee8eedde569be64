"""Structured Streaming: incremental ingest of daily files and running scores.

The reference reads whole files once; here new files dropped into a folder are
picked up by a file-source stream.  Each micro-batch is parsed with the batch
parser (``sources.csv.parse_lines``: a file's header and its data lines arrive
in the same batch, as a file is read whole) and committed to a Parquet table
partitioned by batch and site.  A replayed batch (the engine repeats one whose commit it did
not see) overwrites its own partitions and nothing else, so no row is doubled.  ``running_scores`` keeps the additive part of the
accuracy tables (counts, sums of errors and squares, in-band counts) as
streaming state per parameter; everything that needs the whole table (median,
R^2 against a train mean, range shares) is a batch query over the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seriescast.config import EPS, TIGHT_HI, TIGHT_LO
from seriescast.sources.csv import parse_lines
from seriescast.sources.sinks import write_table


def daily_files_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return (spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
            .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file")))


def commit_batch(lines: DataFrame, epoch: int, out: str, params: list[str] | None = None) -> None:
    """Write one micro-batch under ``batch=<epoch>``; writing it again replaces it."""
    rows = parse_lines(lines, params).withColumn("batch", F.lit(int(epoch)).cast("long"))
    write_table(rows, out, by=["batch", "site"], only_touched=True)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str,
           params: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Parse every new file and commit it to ``out`` (Parquet, partitioned by batch and site)."""
    def write(batch: DataFrame, epoch: int) -> None:
        commit_batch(batch, epoch, out, params)

    w = daily_files_stream(spark, folder).writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def running_scores(pred_stream: DataFrame) -> DataFrame:
    """Additive accuracy state per parameter over a stream of ``param, actual, predicted``."""
    e = F.col("actual") - F.col("predicted")
    ratio = e / (F.col("predicted") + EPS)
    agg = pred_stream.groupBy("param").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(e * e).alias("sse"),
        F.sum(F.abs(e)).alias("sae"),
        F.count_if((ratio >= TIGHT_LO) & (ratio <= TIGHT_HI)).alias("in_range"),
    )
    return agg.withColumns({"mse": F.col("sse") / F.col("n"), "mae": F.col("sae") / F.col("n"),
                            "in_range_pct": F.col("in_range") / F.col("n") * 100})
