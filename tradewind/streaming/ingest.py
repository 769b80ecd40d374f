"""Bronze ingestion as a stream: files that arrive in a folder are inserted by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tradewind.sources.lakehouse import Lakehouse


def open_csv_stream(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str],
    free_text: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    """The CSV files of a folder as a stream of STRING columns; options as in `read_csv`."""
    reader = spark.readStream.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder, header=True, quote='"', escape='"', multiLine=free_text)


def ingest_stream(
    stream: DataFrame,
    lake: Lakehouse,
    table: str,
    keys: Sequence[str],
    checkpoint: str,
    layer: str = "bronze",
    event_time: str | None = None,
    max_delay: str = "1 day",
) -> StreamingQuery:
    """Insert the rows whose key the table does not hold yet, then stop once no input is left.

    Replaying a micro-batch after a failure adds nothing, since its keys are in the table by
    then (rows with a NULL key never match and are the exception). With `event_time`, copies
    that arrive within `max_delay` of each other are dropped in the stream already, with state
    bounded by that delay; rows later than that behind the newest row of earlier batches are
    dropped as well. Leave it out where late rows must come in, whatever their age.
    """
    if event_time is not None:
        stream = stream.withColumn(event_time, stream[event_time].try_cast("timestamp"))
        stream = stream.withWatermark(event_time, max_delay).dropDuplicatesWithinWatermark(list(keys))

    def insert(batch: DataFrame, _: int) -> None:
        lake.insert_new(layer, table, batch, keys)

    return (
        stream.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
