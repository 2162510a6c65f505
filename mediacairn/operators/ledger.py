"""Decision ledger: outcomes, runs, reports and reconciliation."""

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, gate as g, outcomes as o
from .hotkeys import latest_per_key

OUTCOME = ["status", "output_path", "actual_savings_mb", "error"]


def marked(decisions: DataFrame, updates: DataFrame) -> DataFrame:
    """The ledger with outcomes set, and rejected updates, in one table: `rejected` tells them apart.

    updates: id, expected_path (null skips the check), status, output_path, actual_savings_mb, error, run_id (null keeps
    the row's), at most one per id. An update whose id is unknown or whose path differs changes nothing. Ids are unique
    in the ledger; where they come from a hash, give expected_path.
    """
    u = updates.withColumnsRenamed({c: "__" + c for c in updates.columns})
    known, asked = F.col("path").isNotNull(), F.col("__id").isNotNull()
    hit = known & asked & (F.col("__expected_path").isNull() | (F.col("__expected_path") == F.col("path")))
    changed = {c: F.when(hit, F.col("__" + c)).otherwise(F.col(c)) for c in OUTCOME}
    changed["run_id"] = F.when(hit, F.coalesce("__run_id", "run_id")).otherwise(F.col("run_id"))
    kinds = dict(decisions.dtypes)
    done = F.struct(*[changed.get(c, F.col(c)).alias(c) for c in decisions.columns], F.lit(False).alias("rejected"))
    given = {c: F.col("__" + c) for c in updates.columns} | {"path": F.col("__expected_path")}
    no = F.struct(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in decisions.columns], F.lit(True).alias("rejected"))
    rows = decisions.join(u, F.col("id") == F.col("__id"), "full")
    return rows.select(F.inline(F.array_compact(F.array(F.when(known, done), F.when(asked & ~hit, no)))))


def mark_decision(decisions: DataFrame, updates: DataFrame):
    """(ledger with outcomes set, rejected updates); see `marked`, which gives both at once."""
    both = marked(decisions, updates)
    return (both.filter(~F.col("rejected")).drop("rejected"),
            both.filter("rejected").select("id", F.col("path").alias("expected_path"), *OUTCOME, "run_id"))


def _rejected(decisions, updates):
    d = decisions.select(F.col("id").alias("__id"), F.col("path").alias("__path"))
    return updates.join(d, (F.col("id") == F.col("__id")) & (
        F.col("expected_path").isNull() | (F.col("expected_path") == F.col("__path"))), "left_anti")


def stamp_run(decisions: DataFrame, stamps: DataFrame):
    """Set run_id only. stamps: id, expected_path, run_id; a null run_id does nothing."""
    live = stamps.filter(F.col("run_id").isNotNull())
    u = live.select(*[F.col(c).alias("__" + c) for c in ("id", "expected_path", "run_id")])
    same = (F.col("id") == F.col("__id")) & (
        F.col("__expected_path").isNull() | (F.col("__expected_path") == F.col("path")))
    done = decisions.join(u, same, "left").select(*[
        F.coalesce("__run_id", "run_id").alias(c) if c == "run_id" else F.col(c)
        for c in decisions.columns])
    return done, _rejected(decisions, live)


def decisions_latest(events: DataFrame, version=("event_at",)) -> DataFrame:
    """Current row per id from the append-only event table."""
    return latest_per_key(events, ["id"], list(version))


def decisions_for_run(decisions: DataFrame, run_id: int) -> DataFrame:
    return (decisions.filter(F.col("run_id") == run_id)
            .orderBy(F.coalesce("actual_savings_mb", F.lit(-1)).desc(), F.col("id").asc())
            .select("id", "path", "status", "output_path", "actual_savings_mb", "error"))


def run_lifecycle(events: DataFrame) -> DataFrame:
    """Start and end events -> one row per run."""
    start, end = F.col("event") == "start", F.col("event") == "end"
    return events.groupBy("run_id").agg(
        F.max(F.when(start, F.col("kind"))).alias("kind"),
        F.max(F.when(start, F.col("root"))).alias("root"),
        F.max_by("args", F.when(start, F.col("at"))).alias("args"),
        F.min(F.when(start, F.col("at"))).alias("started_at"),
        F.max(F.when(end, F.col("at"))).alias("ended_at"),
        F.max_by("summary", F.when(end, F.col("at"))).alias("summary"))


def get_run(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)


def recent_runs(runs: DataFrame, n=10) -> DataFrame:
    return (runs.withColumn("duration_s", F.when(F.col("ended_at").isNotNull(),
                                                 F.col("ended_at") - F.col("started_at")).otherwise(0))
            .orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n))


def latest_run_completed(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    done = decisions.filter("status = 'completed'").select("run_id").distinct()
    return (runs.join(done, "run_id", "left_semi")
            .orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1).select("run_id"))


def replace_list(decisions: DataFrame) -> DataFrame:
    """Files with two or more stall failures, newest first."""
    return (decisions.filter(o.is_stall_failure()).groupBy("path")
            .agg(F.count(F.lit(1)).alias("fails"), F.max("decided_at").alias("last_failed_at"))
            .filter(F.col("fails") >= fixed.STALL_LIMIT)
            .orderBy(F.col("last_failed_at").desc(), "path"))


def with_class(decisions: DataFrame) -> DataFrame:
    return (decisions.withColumn("class", o.classify_decision(F.col("status"), F.col("output_path")))
            .withColumn("error_token", o.error_token(F.col("error"))))


def run_report(decisions: DataFrame) -> DataFrame:
    """Counts per class and space saved, per run."""
    cls = F.col("class")
    return (with_class(decisions).groupBy("run_id").agg(
        F.count_if(cls == "ok").alias("encoded"), F.count_if(cls == "fail").alias("failed"),
        F.count_if(cls == "skip").alias("skipped"), F.count_if(cls == "dry").alias("dry_run"),
        F.coalesce(F.sum(F.when(cls == "ok", F.col("actual_savings_mb"))), F.lit(0)).alias("saved_mb")))


def report_lines(decisions: DataFrame) -> DataFrame:
    """Report lines with their place: run, section, savings, id."""
    rows = with_class(decisions)
    return (rows.filter("class <> 'other'").select(
        "run_id", o.section_order(F.col("class")).alias("section"),
        F.coalesce("actual_savings_mb", F.lit(-1)).alias("savings"), "id",
        o.report_line(F.col("class")).alias("line")))


def failure_breakdown(decisions: DataFrame) -> DataFrame:
    """Failures per run, one column per token."""
    tokens = sorted({t for _, t in fixed.ERROR_TOKENS} | {fixed.ERROR_TOKEN_DEFAULT})
    return (with_class(decisions).filter("class = 'fail'").groupBy("run_id")
            .pivot("error_token", tokens).count().na.fill(0))


def pending_status(decisions: DataFrame, n=10) -> DataFrame:
    """The top n pending rows; each carries the number of all pending rows."""
    pending = decisions.filter("status = 'pending'")
    total = pending.agg(F.count(F.lit(1)).alias("n_pending"))
    top = pending.orderBy(F.coalesce("projected_savings_mb", F.lit(0)).desc(), "id").limit(n)
    return top.withColumn("n_pending", total.scalar())


def validate_outputs(jobs: DataFrame, probes: DataFrame, outputs: DataFrame) -> DataFrame:
    """Add `valid` and `reason` to jobs (path, output_path).

    outputs: path, parsed, has_video, duration_seconds, size of each output probe.
    """
    src = probes.select(F.col("path").alias("__sp"), F.col("duration_seconds").alias("__sd"),
                        F.col("size").alias("__ss"))
    out = outputs.select(F.col("path").alias("__op"), F.col("parsed").alias("__ok"),
                         F.col("has_video").alias("__hv"),
                         F.coalesce("duration_seconds", F.lit(0)).alias("__od"),
                         F.col("size").alias("__os"))
    ratio = F.col("__od") / F.col("__sd")
    reason = (F.when(~F.coalesce("__ok", F.lit(False)), "unreadable output")
              .when(~F.coalesce("__hv", F.lit(False)), "no video stream")
              .when(F.coalesce("__sd", F.lit(0)) <= 0, F.lit(None))
              .when(~ratio.between(0.95, 1.05), "duration mismatch")
              .when(F.col("__os").isNull(), "no output size")
              .when((F.col("__ss") > 0) & (F.col("__os") >= F.col("__ss")), "output not smaller"))
    return (jobs.join(src, F.col("path") == F.col("__sp"), "left")
            .join(out, F.col("output_path") == F.col("__op"), "left")
            .withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
            .withColumn("saved_mb", F.when(F.col("valid"), actual_savings(F.col("__ss"), F.col("__os"))))
            .drop("__sp", "__sd", "__ss", "__op", "__ok", "__hv", "__od", "__os"))


def actual_savings(source_size, output_size):
    return (source_size - F.coalesce(output_size, F.lit(0))) / fixed.MIB


def bloat_after_encode(jobs: DataFrame, enabled=True) -> DataFrame:
    """Add `bloated`. jobs: height, quality, input_size, output_size, retried.

    input_size is what the encoder read: the prepared file if there was one.
    """
    applies = g.bloat_applies(F.col("height"), F.col("input_size"), F.col("quality"),
                              enabled, F.col("retried"))
    big = F.coalesce("output_size", F.lit(0)) >= F.col("input_size") * fixed.BLOAT_RATIO
    return jobs.withColumn("bloated", applies & big)


def cleanup_guard(decisions: DataFrame, listing: DataFrame) -> DataFrame:
    """Completed rows with `reason` (null = cleanable) and the source size to free.

    Use the unfiltered listing: a zero-byte output differs from a missing one.
    """
    rows = decisions.filter("status = 'completed'").withColumn(
        # a missing output name takes the row's own path as key, so that such
        # rows spread over the cluster; the first reason below catches them
        "__ok", F.coalesce(F.nullif("output_path", F.lit("")), F.col("path")))
    out = listing.select(F.col("path").alias("__op"), F.col("size").alias("__os"))
    src = listing.select(F.col("path").alias("__sp"), F.col("size").alias("__ss"))
    rows = (rows.join(out, F.col("__ok") == F.col("__op"), "left")
            .join(src, F.col("path") == F.col("__sp"), "left"))
    reason = (F.when(F.coalesce("output_path", F.lit("")) == "", "no output_path recorded")
              .when(F.col("output_path") == F.col("path"), "output_path == source_path")
              .when(F.col("__op").isNull(), "output missing")
              .when(F.col("__os") <= 0, "output zero-byte")
              .when(F.col("__sp").isNull(), "source already removed"))
    return (rows.withColumn("reason", reason)
            .withColumn("source_size", F.when(F.col("reason").isNull(), F.col("__ss")).otherwise(0))
            .drop("__ok", "__op", "__os", "__sp", "__ss"))


def cleanup_summary(decisions: DataFrame, listing: DataFrame, runs: DataFrame, run_id=None) -> DataFrame:
    """Cleanable and skipped files of one run; the latest completed run by default."""
    if run_id is None:
        chosen = latest_run_completed(runs, decisions)  # one row
        rows = decisions.join(F.broadcast(chosen), "run_id", "left_semi")
    else:
        rows = decisions.filter(F.col("run_id") == run_id)
    return (cleanup_guard(rows, listing).groupBy("run_id").agg(
        F.count_if(F.col("reason").isNull()).alias("cleanable"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped"),
        F.sum("source_size").alias("reclaimable_bytes")))


def ledger_reconcile(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Run summaries beside what the ledger says; runs on either side are kept.

    runs: run_id, applied, failed, skipped as the summary states them.
    """
    ledger = decisions.groupBy("run_id").agg(
        F.count_if(F.col("status") == "completed").alias("ledger_applied"),
        F.count_if(F.col("status") == "failed").alias("ledger_failed"),
        F.count_if(F.col("status") == "skipped").alias("ledger_skipped"))
    both = runs.select("run_id", "applied", "failed", "skipped").join(ledger, "run_id", "full_outer")
    agree = F.lit(True)
    for c in ("applied", "failed", "skipped"):
        agree = agree & (F.coalesce(c, F.lit(0)) == F.coalesce("ledger_" + c, F.lit(0)))
    return both.withColumn("agrees", agree)
