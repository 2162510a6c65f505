"""State tables on Parquet: probes, decisions, runs, skipped_files, and any other table that is merged into.

A table is a folder of partitions by a hash of its key. An update reads and replaces only the partitions its rows fall
into, by Spark's dynamic partition overwrite: new files are written aside and moved in when the job commits, so a job
that dies leaves the table as it was, and files of other partitions stay untouched. Each partition written holds one row
that is no row of the table, so that a partition can become empty; readers leave it out. One writer per table.
"""

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators.hotkeys import latest_per_key

PARTS = 64
#: name -> (columns, key)
TABLES = {
    "probes": (schemas.PROBE + ", last_probed_at double", "path"),
    "decisions": (schemas.DECISION, "path"),
    "runs": (schemas.RUN, "id"),
    "skipped_files": (schemas.SKIPPED, "path"),
}


def nullable(schema: StructType) -> StructType:
    """The schema as files have it: nothing in it is known not to be null."""
    return StructType.fromJson(json.loads(re.sub(r'"(nullable|containsNull|valueContainsNull)":false', r'"\1":true', schema.json())))


class KeyedTable:
    """One table, in `parts` partitions by hash of `key`. Keep `parts` for the life of a table."""

    def __init__(self, spark: SparkSession, where: str, schema, key: str, parts=PARTS):
        self.spark, self.where, self.key, self.parts = spark, where.rstrip("/"), key, parts
        self.schema = nullable(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def _there(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.where + "/part=0")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _part(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.parts)).cast("int")

    def read(self, parts=None) -> DataFrame:
        """All rows, or those of some partitions; other partitions are not listed."""
        if not self._there():
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema.fields, *StructType.fromDDL("is_row boolean, part int").fields])).parquet(self.where)
        if parts is not None:
            rows = rows.filter(F.col("part").isin(list(parts)))
        return rows.filter("is_row").drop("is_row", "part")

    def _put(self, rows: DataFrame, parts) -> None:
        names = self.schema.names
        kept = rows.select(*[F.col(c).cast(f.dataType).alias(c) for c, f in zip(names, self.schema.fields)]).withColumn("is_row", F.lit(True)).withColumn("part", self._part())
        marks = self.spark.createDataFrame([(p,) for p in parts], "part int").select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(False).alias("is_row"), "part")
        # about one file for each partition; adaptive execution splits large ones over more tasks
        (kept.unionByName(marks).hint("rebalance", "part").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.where))

    def write(self, rows: DataFrame) -> None:
        """Replace all rows. `rows` may come from the table itself."""
        self._put(rows, range(self.parts))

    def update(self, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """merge(rows of the touched partitions, delta) -> their new rows. Returns the partitions that were replaced."""
        touched = sorted(r.part for r in delta.select(self._part().alias("part")).distinct().collect())
        if touched:
            # the first update makes all partitions, so that a table is there or not there as a whole
            self._put(merge(self.read(touched), delta), touched if self._there() else range(self.parts))
        return touched

    def merge_latest(self, delta: DataFrame, version) -> list[int]:
        """Keep the row with the largest `version` per key, of the table and the delta; late rows win or lose by it too."""
        names = self.schema.names
        return self.update(delta, lambda old, new: latest_per_key(old.unionByName(new.select(*names)), [self.key], list(version)))


class State:
    """The four state tables under one root."""

    def __init__(self, spark: SparkSession, root: str, parts=PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def table(self, name) -> KeyedTable:
        schema, key = TABLES[name]
        return KeyedTable(self.spark, f"{self.root}/{name}", schema, key, self.parts)

    def read(self, name) -> DataFrame:
        return self.table(name).read()

    def write(self, name, df: DataFrame) -> None:
        self.table(name).write(df)

    def update(self, name, delta: DataFrame, merge) -> list[int]:
        return self.table(name).update(delta, merge)
