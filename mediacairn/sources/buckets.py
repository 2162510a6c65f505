"""Tables kept in buckets of a key, so that joins on it need no exchange.

Listing, probes, skipped files and the ledger meet by path on every scan. Written once in the same number of buckets and
sorted by path, they are joined bucket by bucket where they lie. Tables are external ones in the shared folder.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir

BUCKETS = 64


def join_settings(spark: SparkSession) -> None:
    """Let a join on path and more columns use buckets of path alone."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def bucketed(df: DataFrame, name: str, key="path", buckets=BUCKETS) -> DataFrame:
    """Write `df` as a table of its own in buckets of `key` and read it back."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    # by the buckets' own hash, so that each bucket is one file
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table))
    return spark.table(table)
