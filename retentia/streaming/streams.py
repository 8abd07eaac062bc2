"""Streaming counterparts: windowed rollups, replay removal, folds per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentia.common import scratch


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files below a folder, or one file: the last part of the path becomes a pattern, which either may match."""
    head, _, last = path.rstrip("/").rpartition("/")
    path = f"{head}/[{last[0]}]{last[1:]}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and key; rows later than `late` behind the newest are left to the watermark."""
    w = F.window(time, width)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def without_replays(records: DataFrame, id_col: str, time: str, late: str = "30 days") -> DataFrame:
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([id_col])


def drain(df: DataFrame, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a streaming frame over all that is there now, exactly once per batch, and returns what it wrote to the shared folder.

    With `keys` it runs in update mode: the state holds only what the watermark leaves open, and of the rows of a key the last update counts.
    """
    base = scratch(df.sparkSession, f"stream-{name}")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    q = df.writeStream.outputMode("update" if keys else "append").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])).parquet(f"{base}/out")
    if not keys:
        return out.drop("epoch")
    rest = [c for c in df.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*").select(*df.columns)
