"""Report sinks."""

from pyspark.sql import DataFrame, functions as F

from ..functions import probe as pr
from ..operators.ledger import report_lines
from ..functions.fixed import MIB


def candidate_items(cands: DataFrame) -> DataFrame:
    """One nested item per candidate, numbers rounded to 2 decimals."""
    def two(c):
        return F.bround(c, 2)
    return cands.select(
        "path", two(F.col("size") / MIB).alias("size_mb"),
        two(F.col("duration_seconds").cast("double")).alias("duration_seconds"),
        pr.resolution_class(F.col("height")).alias("resolution"), "video_codec",
        two(F.coalesce("video_bitrate", F.lit(0)) / 1e6).alias("video_bitrate_mbps"),
        "target", "remux_only", "is_hdr",
        F.transform("fired", lambda v: F.struct(
            v["rule"].alias("rule"), v["reason"].alias("reason"), v["severity"].alias("severity"),
            v["projected_savings_mb"].alias("projected_savings_mb"))).alias("fired_rules"),
        F.transform("audio_tracks", lambda t: F.struct(
            t["language"].alias("language"), t["codec"].alias("codec"),
            t["channels"].alias("channels"))).alias("audio_tracks"),
        F.transform("subtitle_tracks", lambda t: F.struct(
            t["language"].alias("language"), t["codec"].alias("codec"))).alias("subtitle_tracks"),
        "projected_savings_mb")


def candidates_summary(cands: DataFrame) -> DataFrame:
    return cands.agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.bround(F.coalesce(F.sum("projected_savings_mb"), F.lit(0.0)), 2)
        .alias("total_projected_savings_mb"))


def write_candidates_json(cands: DataFrame, where: str) -> None:
    """`where`/items: JSON lines, largest savings first; `where`/summary: totals."""
    items = candidate_items(cands).orderBy(F.col("projected_savings_mb").desc(), "path")
    items.drop("projected_savings_mb").write.mode("overwrite").option(
        "ignoreNullFields", "false").json(where + "/items")
    candidates_summary(cands).write.mode("overwrite").json(where + "/summary")


def write_run_report(decisions: DataFrame, where: str) -> None:
    """Text lines per run directory, in section order.

    Range partitioning keeps the order across files and splits a run that holds
    much of the ledger over many tasks.
    """
    order = ["run_id", "section", F.col("savings").desc(), "id"]
    (report_lines(decisions).repartitionByRange(*order).sortWithinPartitions(*order)
     .select("run_id", "line").write.mode("overwrite").partitionBy("run_id").text(where))
