"""A queue of newly imported files: arrivals are merged in, a worker drains it at its pace.

Queue rows: path (unique), seen_at (when the newest arrival came), replaces (the path an upgrade stands for, or null), status:
pending, taken (given to the worker), left (nothing to gain: left alone for good). A file that comes again later than its
row, an upgrade, is pending once more; an arrival that is told twice changes nothing. Rows live in a table that is merged
into by path, see sources.state.KeyedTable.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import rules as r
from .hotkeys import latest_per_key

QUEUE = "path string, seen_at double, replaces string, status string"
#: Rules that make an import worth the work; anything else is fine as it came.
GATE = ("over_bitrate", "legacy_codec")


def merge_arrivals(queue: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The queue with arrivals (path, seen_at, replaces) merged in: of each path the newest, and of equal ones the queue's."""
    fresh = arrivals.select("path", F.col("seen_at").cast("double").alias("seen_at"), "replaces", F.lit("pending").alias("status"), F.lit(0).alias("held"))
    both = queue.select("path", "seen_at", "replaces", "status", F.lit(1).alias("held")).unionByName(fresh)
    return latest_per_key(both, ["path"], ["seen_at", "held", "replaces"]).drop("held")


def gated(queue: DataFrame, probes: DataFrame, rules=GATE) -> DataFrame:
    """Pending rows with `gate`: take, left, or unprobed (not looked at yet, it waits)."""
    judged = probes.select(F.col("path").alias("__p"), r.any_firm(list(rules)).alias("__hit"))
    rows = queue.filter("status = 'pending'").join(judged, F.col("path") == F.col("__p"), "left")
    gate = F.when(F.col("__p").isNull(), "unprobed").when(F.col("__hit"), "take").otherwise("left")
    return rows.withColumn("gate", gate).drop("__p", "__hit")


def drain(queue: DataFrame, probes: DataFrame, limit: int, rules=GATE) -> DataFrame:
    """Rows that change: the `limit` oldest that are worth it become taken, all that are not become left.

    Merge them back by path. Only the first rows of each task reach the one that picks them.
    """
    rows = gated(queue, probes, rules)
    first = rows.filter("gate = 'take'").orderBy("seen_at", "path").limit(limit)
    return (first.withColumn("status", F.lit("taken")).drop("gate")
            .unionByName(rows.filter("gate = 'left'").withColumn("status", F.lit("left")).drop("gate")))


def settle(queue: DataFrame, changed: DataFrame) -> DataFrame:
    """The queue with the rows of `drain`, but for paths that have come again in between: those stay pending."""
    new = changed.select(F.col("path").alias("__p"), F.col("seen_at").alias("__at"), F.col("status").alias("__s"))
    met = (F.col("path") == F.col("__p")) & (F.col("seen_at") == F.col("__at"))
    return queue.join(new, met, "left").withColumn("status", F.coalesce("__s", "status")).drop("__p", "__at", "__s")


def outdated_outputs(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Finished outputs of files that an upgrade replaces: path (of the replaced file), output_path, by (the upgrade)."""
    old = queue.filter("replaces IS NOT NULL").select(F.col("replaces").alias("path"), F.col("path").alias("by"))
    done = decisions.filter("status = 'completed' AND output_path IS NOT NULL AND output_path <> ''").groupBy("path").agg(
        F.max_by("output_path", F.struct("decided_at", "id")).alias("output_path"))
    return old.join(done, "path").select("path", "output_path", "by")
