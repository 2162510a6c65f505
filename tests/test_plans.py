"""Shapes of physical plans."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mediacairn.operators import incremental as inc, progress
from mediacairn.operators.hotkeys import running
from mediacairn.plans.registry import QUERIES
from mediacairn.sources import buckets

SF = "/root/testdata/sf0.001"
EAGER = {"read_write_state", "write_candidates_json", "write_run_report", "progress_windows_stream",
         "incremental_scan_stream", "scan_tree", "import_queue", "stall_watchdog_stream", "probe_scan_stream", "recycle_destination"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_python_and_no_product(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text, bad


def test_scan_reads_few_columns_and_never_shuffles(spark):
    text = plan(entry.queries()["scan_listing"](spark, SF))
    assert "Exchange" not in text and "o_comment" not in text


def test_queue_is_a_top_n(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["rank_queue"](spark, SF))


def test_nested_ladder_needs_no_shuffle(spark):
    assert "Exchange" not in plan(entry.queries()["audio_ladder_nested"](spark, SF))


def test_checkpoint_lines_are_cut_before_the_shuffle(spark):
    text = plan(entry.queries()["bloat_projection"](spark, SF))
    assert "row_number(), 4, Partial" in text


@pytest.fixture
def feed(spark, tmp_path):
    """Lines and encodes as tables on disk, with broadcasts off."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    lines = spark.range(5000).selectExpr("id % 7 AS encode_id", "id AS t_s", "id AS seq", "concat('frame= ', id) AS line", "array(id) AS more")
    encodes = spark.range(7).selectExpr("id AS encode_id", "0L AS start_s", "100D AS duration_seconds", "24D AS source_fps")
    out = []
    for name, df in (("lines", lines), ("encodes", encodes)):
        df.write.parquet(f"{tmp_path}/{name}")
        out.append(spark.read.parquet(f"{tmp_path}/{name}"))
    yield out
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def final_counts(df):
    """(scans, keyed exchanges) of the plan as it ran, reused exchanges not counted."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()
    text = qe.executedPlan().toString()
    text = text.split("== Initial Plan ==")[0] if "== Final Plan ==" in text else text
    kept = "\n".join(x for x in text.splitlines() if "ReusedExchange" not in x)
    return len(re.findall(r"Scan parquet", kept)), len(re.findall(r"Exchange hashpartitioning", kept))


def test_running_values_read_once_and_exchange_thrice(feed):
    lines, _ = feed
    rows = lines.withColumn("c", F.floor(F.col("t_s") / 500))
    got = running(rows, ["encode_id"], "c", ["t_s"], row_number="n", sums={"s": "seq"}, lasts={"l": "line"}, previous_only=["s"])
    assert final_counts(got) == (1, 3)


def test_progress_state_reads_each_table_once_and_exchanges_thrice(feed):
    lines, encodes = feed
    state = progress.progress_state(progress.progress_parse(lines), encodes)
    assert final_counts(progress.progress_speed_eta(state)) == (2, 3)


def test_watchdog_gathers_lines_once(feed):
    lines, encodes = feed
    state = lines.select("encode_id", "t_s", "seq", F.col("t_s").cast("double").alias("current_seconds"), F.col("seq").alias("frames"))
    # lines by chunk, maps and encodes by encode, carried pairs by chunk, alarms by encode
    assert final_counts(progress.stall_watchdog(state, encodes)) == (2, 5)


def test_joins_of_tables_in_buckets_need_no_exchange(spark):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")
    before = [spark.conf.get(s) for s in settings]
    try:
        spark.conf.set(settings[0], "-1")
        buckets.join_settings(spark)
        rows = spark.range(1000).selectExpr("concat('/', id) AS path", "id AS size", "double(id % 9) AS mtime")
        listing = buckets.bucketed(rows.filter("size % 10 <> 0"), "listing", buckets=8)
        probes = buckets.bucketed(rows.withColumn("mtime", F.expr("if(size % 7 = 0, -1D, mtime)")), "probes", buckets=8)
        small = buckets.bucketed(rows.filter("size < 100"), "skipped", buckets=8)
        for df, n in ((inc.probe_delta(listing, probes), 128), (inc.stale_prune(probes, listing), 900), (inc.probe_cache_lookup(listing, probes), 900),
                      (inc.skip_clear(small, listing), 10), (inc.skip_lookup(listing, small), 90)):
            assert df.count() == n
            assert "Exchange" not in plan(df)
    finally:
        for s, v in zip(settings, before):
            spark.conf.set(s, v)
