"""Listing of a directory tree that loses nothing: Spark's Python data source over a mounted file system.

Spark's own file source leaves out empty files and names that start with `.` or `_`. This one walks directories as they
are. The driver opens directories from the root down, breadth first, until there are enough sub-trees to share out; each
of these is one partition, and so are the files of the directories opened on the way. Nothing is read but directory
entries. All executors must see the tree under the same path.

Links are followed where they lead inside the root, and not to a directory that holds the link itself; others are left
out. What cannot be read is a row with `error` and without size, so a scan can count it.
"""

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import importable

NAME = "file_tree"


class SubTree(InputPartition):
    """A directory, with all below it or with its own files only."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def inside(path: str, root: str) -> bool:
    return path == root or path.startswith(root.rstrip("/") + "/")


def followed(entry: os.DirEntry, root: str) -> bool:
    """Is this entry to be looked at? root: the root with its links resolved."""
    if not entry.is_symlink():
        return True
    target = os.path.realpath(entry.path)
    return inside(target, root) and not inside(os.path.realpath(os.path.dirname(entry.path)), target)


def walk(path: str, root: str, deep: bool) -> Iterator[tuple]:
    """(path, size, mtime, error) of the files of a directory, and below it if deep."""
    stack = [path]
    while stack:
        at = stack.pop()
        try:
            with os.scandir(at) as entries:
                for e in entries:
                    try:
                        if not followed(e, root):
                            continue
                        if e.is_dir():
                            if deep:
                                stack.append(e.path)
                        elif e.is_file():
                            st = e.stat()
                            yield e.path, st.st_size, st.st_mtime, None
                    except OSError as err:
                        yield e.path, None, None, type(err).__name__
        except OSError as err:
            yield at, None, None, type(err).__name__


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.deep = options.get("recursive", "true").lower() == "true"
        self.parts = int(options.get("parts", "200"))

    def partitions(self):
        if not os.path.isdir(self.root) or not self.deep:
            return [SubTree(self.root, False)]
        real, done, level = os.path.realpath(self.root), [], [self.root]
        while level and len(level) < self.parts:
            below = []
            for at in level:
                try:
                    with os.scandir(at) as entries:
                        below += [e.path for e in entries if followed(e, real) and e.is_dir()]
                except OSError:
                    pass  # its own partition reports it
            done += level
            level = below
        return [SubTree(p, False) for p in done] + [SubTree(p, True) for p in level]

    def read(self, partition):
        if not os.path.isdir(partition.path):  # a root that is a file, or is gone
            try:
                st = os.stat(partition.path)
                yield partition.path, st.st_size, st.st_mtime, None
            except OSError as err:
                yield partition.path, None, None, type(err).__name__
            return
        yield from walk(partition.path, os.path.realpath(self.root), partition.deep)


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return "path string, size bigint, mtime double, error string"

    def reader(self, schema):
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, recursive=True, parts=200) -> DataFrame:
    """path, size, mtime, error of every file under `root`."""
    importable(spark)
    spark.dataSource.register(TreeSource)
    return (spark.read.format(NAME).option("recursive", str(recursive).lower()).option("parts", str(parts)).load(root))


def split_errors(tree: DataFrame):
    """(listing, entries that could not be read)."""
    return tree.filter("error IS NULL").drop("error"), tree.filter("error IS NOT NULL").select("path", "error")
