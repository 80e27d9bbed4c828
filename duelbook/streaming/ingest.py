"""The append job as a stream: keep-first by key, run to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelbook.operators.sides import first_of_key
from duelbook.session import scratch_path


def landed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(path)
    # Watermarks need instants: zone-less stamps are read in the session zone.
    plain = [c for c, kind in rows.dtypes if kind == "timestamp_ntz"]
    return rows.withColumns({c: rows[c].cast("timestamp") for c in plain}) if plain else rows


def keep_first_stream(stream: DataFrame, key: list[str], event_time: str, late: str = "1 day") -> DataFrame:
    """First arrival of each key with bounded state; rows behind the watermark are dropped.

    For sources that are known to be late by less than ``late``. ``run_append_new`` keeps every late row.
    """
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes all landed files, then stops; a restart with the same checkpoint goes on where it ended."""
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_append_new(stream: DataFrame, table: str, checkpoint: str, key: list[str], order: list, buckets: int = 64) -> None:
    """Appends to a parquet table only keys it does not hold, however late; processes all that has landed, then stops.

    Rows are stored by hash bucket of their key, and a batch reads the buckets it touches only. A batch writes to the folder of its
    own number in overwrite mode, so a replayed batch after a lost driver replaces its first try instead of doubling
    rows. A restart with the same checkpoint goes on where it ended.
    """
    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = first_of_key(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        if number > 0:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            schema = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
            held = spark.read.schema(schema).parquet(table).where((F.col("batch") < number) & F.col("bucket").isin(touched))
            fresh = fresh.join(held.select("bucket", *key).distinct(), ["bucket", *key], "left_anti")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingest(spark: SparkSession, stream: DataFrame, key: list[str], order: list) -> DataFrame:
    """Runs the append job into a fresh table of the shared folder and reads it back."""
    folder = scratch_path(spark, "stream")
    run_append_new(stream, f"{folder}/out", f"{folder}/checkpoint", key, order)
    return spark.read.parquet(f"{folder}/out").drop("batch", "bucket")
