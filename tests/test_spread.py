"""Wide work is spread over tasks, and the cost of a stream doesn't grow with the number of its files."""

from pyspark.sql import functions as F

from mediacairn.operators import incremental as inc
from mediacairn.plans.fixtures import Tables
from mediacairn.plans import ledger_queries  # noqa: F401
from mediacairn.plans.registry import QUERIES
from mediacairn.streaming import jobs, scan

SF = "/root/testdata/sf0.001"


def test_documents_of_one_row_group_are_made_in_many_tasks(spark, tmp_path):
    spark.read.parquet(f"{SF}/orders.parquet").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    docs = Tables(spark, str(tmp_path)).probe_docs()
    assert docs.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_probe_feed_of_many_files_is_merged_a_few_times(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF}/orders.parquet").repartition(9).write.parquet(f"{tmp_path}/orders.parquet")
    batches = []
    merge = scan.KeyedTable.merge_latest
    monkeypatch.setattr(scan.KeyedTable, "merge_latest", lambda self, *a: batches.append(1) or merge(self, *a))
    got = QUERIES["probe_scan_stream"](spark, str(tmp_path)).collect()
    assert 2 <= len(batches) <= jobs.PROBE_BATCHES + 1
    assert sorted(map(str, got)) == sorted(map(str, QUERIES["probe_scan_stream"](spark, SF).collect()))


def test_bad_documents_of_the_feed_are_rows_with_a_reason(spark):
    good = '{"format": {"duration": "5"}, "streams": [{"codec_type": "video", "codec_name": "h264", "width": "%s"}]}'
    docs = spark.createDataFrame([("/a.mkv", 7, 1.0, good % 640), ("/b.mkv", 8, 1.0, "{"), ("/c.mkv", 9, 1.0, '{"streams": []}'), ("/d.mkv", 1, 1.0, good % 99999999999)],
                                 "path string, stat_size bigint, mtime double, doc string")
    rows = {r.path: r for r in scan.probe_rows(docs).collect()}
    assert {p: r.reason for p, r in rows.items()} == {"/a.mkv": None, "/b.mkv": "not json", "/c.mkv": "no video stream", "/d.mkv": "bad number"}
    assert (rows["/a.mkv"].video_codec, rows["/a.mkv"].width, rows["/a.mkv"].size, rows["/d.mkv"].width) == ("h264", 640, 7, 0)


def test_upsert_reads_the_table_and_the_delta_once(spark, tmp_path):
    ddl = "path string, size bigint, mtime double, last_probed_at double"
    for name, rows in (("old", [("/a", 1, 1.0, 1.0), ("/b", 2, 1.0, 5.0), (None, 3, 1.0, 1.0)]),
                       ("new", [("/a", 7, 1.0, 2.0), ("/a", 6, 1.0, 1.5), ("/b", 8, 1.0, 2.0), ("/c", 9, 1.0, 2.0), (None, 4, 1.0, 2.0)])):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}")
    got = inc.probe_upsert(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("old", "new")])
    assert sorted(((r.path or "", r.size) for r in got.collect())) == [("", 3), ("", 4), ("/a", 7), ("/b", 2), ("/c", 9)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
