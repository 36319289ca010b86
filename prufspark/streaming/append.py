"""Incremental append to a chunk store: batch upsert and its streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_rows(delta: DataFrame, store: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Rows of ``delta`` whose key the store lacks, the first of each key."""
    w = Window.partitionBy(key).orderBy(order or key)
    first = delta.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.join(store.select(key), key, "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_stream(stream: DataFrame, store: str, checkpoint: str, key: str = "id", time: str = "ingested_at"):
    """Starts a query that appends each key once to the Parquet store, whatever its time.

    Every batch writes its own part, ``epoch=n``, over what an earlier try of it wrote, and asks the parts before it; so
    a batch that runs again changes nothing. Any error but a store that is not there yet ends the query."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch
        if _exists(spark, store):
            known = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("epoch", T.LongType())])).parquet(store)
            fresh = new_rows(batch, known.where(F.col("epoch") < epoch).select(key), key, time)
        else:
            fresh = new_rows(batch, batch.select(key).where(F.lit(False)), key, time)
        fresh.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_vectors(delta: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """The rows of ``delta(key, vec)`` whose key the store lacks, the first of each key (by its vector). Vectors must have
    the store's dimension; those that do not end the query when it runs."""
    dims = store.where("vec is not null").agg(F.max(F.size("vec")).alias("_dim"))
    one = delta.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("vec").alias("vec"))
    fresh = one.join(store.select(key), key, "left_anti").crossJoin(F.broadcast(dims))
    wrong = F.col("_dim").isNotNull() & (F.size("vec") != F.col("_dim"))
    return fresh.select(key, F.when(wrong, F.raise_error(F.lit("vectors of another dimension"))).otherwise(F.col("vec")).alias("vec"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per type and window; works on a stream and on a table alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
