"""Incremental trip loads driven by Structured Streaming.

New raw trip files arriving in a folder are picked up by a file stream;
each micro-batch goes through the same operators as the batch load (validity
filter, transform, upsert by id_trip inside the batch's pickup months).  A file
stream hands over every file once, whatever the times in it, so there is no
high-water mark here: files may come late or in any order.  The upsert is a
delete+insert by key, so a micro-batch replayed after a failure leaves the same
table.  The caller names the folder of the stream's progress (``checkpoint``,
in storage that outlives the application), so a restart goes on where the
stream stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import scratch_scope
from ..sources import schemas
from ..sources.snapshots import Build
from ..plans import mart, ods
from ..plans.warehouse import upsert_months


def load_trip_batch(batch: DataFrame, zones: DataFrame, trip_root: str, run_ts) -> None:
    """Apply one batch of raw trips to the month-partitioned ODS trip table."""
    spark = batch.sparkSession
    rows = ods.transform_trips(ods.valid_trips(batch), zones, run_ts).withColumn(mart.PICKUP_MONTH, mart.trip_month())
    with scratch_scope(spark):
        build = Build(spark, trip_root)
        upsert_months(build, "", rows, "id_trip", policy="merge")
        build.publish()


def stream_trips(spark: SparkSession, source_dir: str, zones: DataFrame, trip_root: str,
                 run_ts, checkpoint: str, max_files_per_trigger: int | None = None,
                 available_now: bool = True):
    """Start (and, with ``available_now``, finish) a stream of raw trip parquet files."""
    reader = spark.readStream.schema(schemas.schema("taxi_trip"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(source_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        load_trip_batch(batch, zones, trip_root, run_ts)

    writer = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q


def load_weather_batch(batch: DataFrame, boroughs: DataFrame, weather_root: str, run_ts) -> None:
    """Apply one batch of raw weather readings to the ODS weather table (new version)."""
    spark = batch.sparkSession
    build = Build(spark, weather_root)
    build.save(ods.ods_weather_dt(batch, boroughs, run_ts, target=build.stored(""), policy="sync_all_columns", mark=False), "")
    build.publish()


def stream_weather(spark: SparkSession, folders_glob: str, boroughs: DataFrame,
                   weather_root: str, run_ts, header: list[str], checkpoint: str,
                   available_now: bool = True):
    """Stream new hourly weather files (``Weather_<Name>/*.csv`` with a preamble).

    ``header`` is the column order of the files (their header line); the
    borough comes from the folder name, as in the batch reader.
    """
    from pyspark.sql import functions as F
    from ..sources.raw import WEATHER_FOLDERS, conform

    ddl = ", ".join(f"`{n}` {'timestamp_ntz' if n == 'time' else 'double'}" for n in header)
    lines = (spark.readStream.format("text").load(folders_glob)
             .select("value", F.col("_metadata.file_path").alias("_path"))
             .filter(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}")))
    folder = F.regexp_extract("_path", r"(Weather_[^/]+)/", 1)
    mapping = F.create_map(*[F.lit(x) for kv in WEATHER_FOLDERS.items() for x in kv])
    parsed = lines.select(
        F.coalesce(F.try_element_at(mapping, folder), F.regexp_replace(folder, "^Weather_", "")).alias("borough_name"),
        F.from_csv("value", ddl, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm"}).alias("r"))
    raw = parsed.select("borough_name", "r.*")
    from pyspark.sql.types import StructType
    want = StructType([*StructType.fromDDL("borough_name string").fields,
                       *schemas.schema("weather").fields])

    def each(batch: DataFrame, batch_id: int) -> None:
        load_weather_batch(conform(batch, want), boroughs, weather_root, run_ts)

    writer = raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    q = writer.start()
    if available_now:
        q.awaitTermination()
    return q
