"""Streams over the given event table, run until their input is used up.

The event table stands for a feed: user_id is the encode or file, event_id
rises with time.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir, stored
from . import progress, scan

DONE = {"availableNow": True}
#: What a micro-batch reads at most, but for one file larger than that.
BATCH_BYTES = 1 << 30
#: Micro-batches that the probe feed is read in, of about equal bytes; files are not cut, so there may be one more.
PROBE_BATCHES = 2
#: The watched feed runs a thousand times as fast as the events, so that pauses are minutes.
FASTER = 1000
EPOCH_US = 1704067200000000  # 2024-01-01


def _events(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a pattern, since the table may be one file or a folder of files
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(BATCH_BYTES)).parquet(f"{folder}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df: DataFrame, where: str) -> DataFrame:
    """Run a stream to a Parquet table in the shared folder and read it back."""
    q = (df.writeStream.format("parquet").option("path", where + "/out")
         .option("checkpointLocation", where + "/state").outputMode("append").trigger(**DONE).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(where + "/out")


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _fast(ts):
    """Microseconds of an event in the watched feed."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) - EPOCH_US) / FASTER).cast("bigint") + EPOCH_US


def _lines(spark, folder):
    """One feed line per event: frame counters that fall at times, positions, errors that say nothing, sizes."""
    n, said = F.col("event_id"), F.col("event_type")
    line = (F.when(said == "error", "progress=continue")
            .when(said == "purchase", F.concat(F.lit("out_time_ms="), ((n % 5000) * 1000000).cast("string")))
            .otherwise(F.concat(F.lit("frame= "), F.when(n % 3 == 0, F.floor(n / 2)).otherwise(n).cast("string"))))
    return _events(spark, folder).select(
        F.col("user_id").alias("encode_id"), F.timestamp_micros(_fast(F.col("ts"))).alias("ts"), n.alias("seq"), line.alias("line"),
        (n % 97 * 1000000).cast("bigint").alias("out_size"))


def windows_over_events(spark, folder) -> DataFrame:
    """Windows still open at the end of the input are closed by a last batch job."""
    lines = _events(spark, folder).select(
        F.col("user_id").alias("encode_id"), "ts", F.concat(F.lit("frame= "), F.col("event_id").cast("string")).alias("line"))
    where = _place(spark, "windows")

    def store(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={epoch}")
    # update mode: each batch writes the windows it changed, the reader keeps the newest
    q = (progress.windows(lines).writeStream.foreachBatch(store).outputMode("update")
         .option("checkpointLocation", where + "/state").trigger(**DONE).start())
    q.awaitTermination()
    rows = spark.read.option("basePath", where + "/out").parquet(where + "/out")
    rows = rows.groupBy("encode_id", "window_start").agg(
        F.max_by(F.struct("n_lines", "frames"), "batch").alias("v"))
    return rows.select("encode_id", F.unix_seconds("window_start").alias("start_s"), "v.n_lines", "v.frames")


def latest_over_events(spark, folder) -> DataFrame:
    where = _place(spark, "scan")
    feed = _events(spark, folder)
    q = scan.start_scan(feed, where + "/rows", where + "/state", DONE, "user_id", ["event_id"])
    q.awaitTermination()
    rows = scan.latest(spark, where + "/rows", feed.schema, "user_id")
    return rows.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("last_event"),
                       F.col("event_type").alias("state"))


def probes_over_documents(spark, docs_of, orders: DataFrame) -> DataFrame:
    """Probe documents as a feed in several micro-batches -> newest typed probe per path, good and bad.

    docs_of: titles (a stream) -> probe documents. The feed holds an older version of some paths in its last files. A
    batch replaces most of the table, so there are PROBE_BATCHES of them, or one a file if files are fewer, and not more
    with more files.
    """
    where = _place(spark, "probes")
    orders.write.parquet(where + "/feed/0")
    orders.filter("o_orderkey % 3 = 0").write.parquet(where + "/feed/1")
    path = spark._jvm.org.apache.hadoop.fs.Path(where + "/feed")
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    feed = (spark.readStream.schema(orders.schema).option("recursiveFileLookup", True)
            .option("maxBytesPerTrigger", str(held // PROBE_BATCHES + 1)).parquet(where + "/feed"))
    rows = scan.probe_rows(docs_of(feed))
    q = scan.start_scan(rows, where + "/rows", where + "/state", DONE, "path", ["mtime", "stat_size"])
    q.awaitTermination()
    return scan.latest(spark, where + "/rows", rows.schema, "path")


def watch_over_events(spark, folder) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    progress.watch_settings(spark)
    try:
        lines = _lines(spark, folder)
        encodes = spark.read.parquet(f"{folder}/events.parquet").groupBy(
            F.col("user_id").alias("encode_id")).agg(F.floor(F.min(_fast(F.col("ts"))) / 1000).alias("start_ms")).select(
            "encode_id", "start_ms", F.when(F.col("encode_id") % 5 == 0, 1200).otherwise(0).cast("bigint").alias("timeout_s"),
            F.when(F.col("encode_id") % 4 == 0, 6600.0).alias("duration_seconds"), F.lit(120000000).cast("bigint").alias("source_size"))
        # read by every micro-batch
        return _run(progress.watch(lines, stored(encodes, "encodes")), _place(spark, "watch"))
    finally:
        spark.conf.set(key, before)
