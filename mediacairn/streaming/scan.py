"""Incremental scan as a stream: new rows in, latest row per file out."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import probe as pr
from ..sources.probe_json import parse_probe_text, tag_probe_errors
from ..sources.state import PARTS, KeyedTable


def start_scan(rows: DataFrame, where: str, checkpoint: str, trigger, key, version, parts=PARTS):
    """Merge every micro-batch into the current table under `where`: one row per key, the one with the largest `version`.

    Only partitions that a batch touches are read and replaced. A row that comes twice does no harm and one that comes
    late wins or loses by its version, so a batch that is run again changes nothing.
    """
    table = KeyedTable(rows.sparkSession, where, rows.schema, key, parts)

    def store(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()  # read for its partitions, and again to be merged
        table.merge_latest(kept, version)
        kept.unpersist()
    return (rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def latest(spark: SparkSession, where: str, schema, key, parts=PARTS) -> DataFrame:
    """The current table: a plain scan."""
    return KeyedTable(spark, where, schema, key, parts).read()


def probe_rows(docs: DataFrame) -> DataFrame:
    """Typed probe rows of a stream of texts, with stat_size; bad ones stay, with a reason and nothing read from the text.

    A row is typed before it is shuffled and stored, since a parsed document is many times as wide.
    """
    tagged = tag_probe_errors(parse_probe_text(docs))
    good = F.col("reason").isNull()
    rows = tagged.withColumn("format", F.when(good, F.col("format"))).withColumn("streams", F.when(good, F.col("streams")))
    return pr.typed(rows.withColumn("video", pr.primary_video(F.col("streams"))), "stat_size", "reason")
