"""Session settings for scripts and tests. A cluster's own session is used as it is."""

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores="8", shuffle_partitions=8) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName("mediacairn")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            # small files over all cores, by splits and not by a shuffle
            .config("spark.sql.files.maxPartitionBytes", "1m").config("spark.sql.files.openCostInBytes", "64k")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the library from where the driver has it; elsewhere it is installed."""
    root, known = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folders that `stored` has made in this process.
_made: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, so that what reads it more than once makes it only once."""
    where = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made.append(where)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def clean_up(spark: SparkSession) -> int:
    """Remove the tables that `stored` has made so far; call it when the results that read them are done with."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
