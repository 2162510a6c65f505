"""Listing tables: from a file system, and the filters a scan applies.

`sources.tree` lists a mounted tree as it is. `read_listing` takes Spark's own file source, for stores that are not
mounted; it leaves out empty files and names that start with `.` or `_`.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, paths as p


def read_listing(spark: SparkSession, root: str, recursive=True) -> DataFrame:
    """Paths, sizes and times under `root`, without opening any file."""
    files = (spark.read.format("binaryFile")
             .option("recursiveFileLookup", str(recursive).lower()).load(root))
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def keep_supported(listing: DataFrame) -> DataFrame:
    return listing.filter(F.lower(p.suffix(p.file_name(F.col("path")))).isin(fixed.VIDEO_EXTENSIONS))


def drop_system_dirs(listing: DataFrame, root: str) -> DataFrame:
    return listing.filter(~p.any_dir_in(p.relative_dir(F.col("path"), root), fixed.SYSTEM_DIRS))


def drop_extras_dirs(listing: DataFrame, root: str) -> DataFrame:
    return listing.filter(~p.any_dir_in(
        F.lower(p.relative_dir(F.col("path"), root)), fixed.EXTRAS_DIRS))


def drop_extras_names(listing: DataFrame) -> DataFrame:
    return listing.filter(~p.has_extras_suffix(p.stem(p.file_name(F.col("path")))))


def keep_usable(listing: DataFrame) -> DataFrame:
    """Non-empty files. An unreadable file has no size."""
    return listing.filter(F.col("size") > 0)


def scan_listing(listing: DataFrame, root: str, recursive=True, skip_extras=True) -> DataFrame:
    """Files a scan takes: filters only, so all of it stays next to the read.

    A root that is itself a file is taken whatever its name. Rows come in no
    order; sort by path where an order matters.
    """
    is_root = F.col("path") == root.rstrip("/")
    rows = keep_usable(keep_supported(listing.filter(p.under_root(F.col("path"), root))))
    rel = p.relative_dir(F.col("path"), root)
    ok = ~p.any_dir_in(rel, fixed.SYSTEM_DIRS)
    if not recursive:
        ok = ok & (rel == "")
    if skip_extras:
        ok = ok & ~p.any_dir_in(F.lower(rel), fixed.EXTRAS_DIRS)
        ok = ok & ~p.has_extras_suffix(p.stem(p.file_name(F.col("path"))))
    return rows.filter(is_root | ok)
