"""Exact deduplication with an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. A 64-bit key of the text is read from its highest bit on. The
directory has 2**DEPTH slots at most; a bucket holds all keys under one prefix, and while it is overfull it splits and
the directory doubles to one bit more. At full depth a bucket is left as it is and only chains grow longer.

Entries are made where equal texts meet byte for byte: key and whole text are the grouping columns, so copies shrink to
one row in each task before they move and a text with very many copies is never gathered. Owner tasks then take ranges
of keys, number the chain of texts under each key, and write their part of the index as files. Every document finds its
entry again by key and digest; that join is on a side with unique keys, which adaptive execution splits where one text
has very many copies.

Nulls and empties: a null text counts as the empty text. A null doc_id is smaller than any other. Of rows that share
the largest doc_id one stays. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import ascii_lower, packed, stored, work_dir

DEPTH = 16
CAPACITY = 4096


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, norm, key, slot) of every document."""
    return (docs.select("doc_id", ascii_lower(F.col("text")).alias("norm"))
            .withColumn("key", F.xxhash64("norm"))
            .withColumn("slot", F.shiftrightunsigned("key", 64 - DEPTH).cast("int")))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, depth, bucket) for every slot in use: 2**DEPTH rows at most, whatever the input.

    Sizes of all prefixes are counted at once; doubling stops for a prefix at the first depth at which it fits.
    bucket is the first slot under the prefix, so buckets lie in the order of their keys.
    """
    sizes = keys.groupBy("slot", "key").agg(F.count(F.lit(1))).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    at_depth = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("depth")
    prefix = F.expr(f"shiftleft(shiftright(slot, {DEPTH} - depth), {DEPTH} - depth)").alias("bucket")
    nodes = sizes.select("slot", "n", at_depth).select("slot", "n", "depth", prefix)
    held = nodes.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    fits = (F.col("held") <= capacity) | (F.col("depth") == DEPTH)
    return (nodes.join(held, ["depth", "bucket"]).filter(fits)
            .groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b"))
            .select("slot", "b.depth", "b.bucket"))


def build_index(docs: DataFrame, folder: str, capacity: int = CAPACITY):
    """Write the index; returns (rows: one per document, entries: one per different text)."""
    rows = stored(keyed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "slot",
                                     F.sha2("norm", 256).alias("text_sha256")), f"{folder}/rows")
    slots = stored(directory(rows, capacity), f"{folder}/directory")
    texts = (keyed(docs).groupBy("slot", "key", "norm")
             .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    entries = texts.select("slot", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    owned = (entries.join(F.broadcast(slots), "slot")
             .repartitionByRange(F.col("bucket"), F.col("key"))
             .withColumn("chain", F.row_number().over(W.partitionBy("bucket", "key").orderBy("text_sha256"))))
    return rows, stored(owned.select("bucket", "depth", "key", "chain", "text_sha256", "keep_id", "group_size"),
                        f"{folder}/entries")


def exact_groups(docs: DataFrame, folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, same (rows that repeat the kept one)."""
    rows, entries = build_index(docs, folder or work_dir(docs.sparkSession, "exact-index"), capacity)
    found = rows.join(entries, ["key", "text_sha256"])
    largest = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # rows that repeat the largest doc_id: the first of them stays
    stays = (found.filter(largest).groupBy("key", "text_sha256")
             .agg(F.min("row").alias("stays"), F.count(F.lit(1)).alias("same"))
             .withColumnsRenamed({"key": "k", "text_sha256": "s"}))
    is_it = (F.col("row") == F.col("stays")) & (F.col("key") == F.col("k")) & (F.col("text_sha256") == F.col("s"))
    return (found.join(stays, is_it, "left")
            .select("doc_id", "keep_id", "group_size", F.col("stays").isNotNull().alias("kept"), "text_sha256", "bucket", "same"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of equal texts the one with the largest doc_id.

    Rows that repeat doc_id and text leave one row, whatever their other columns hold.
    """
    folder = work_dir(docs.sparkSession, "exact-kept")
    kept = stored(exact_groups(docs).filter("kept")
                  .select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "same"), folder)
    there = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.sha2(ascii_lower(F.col("row.text")), 256) == F.col("sha"))
    once = packed(docs).join(kept.filter("same = 1"), there).select("row.*")
    if kept.filter("same > 1").isEmpty():
        return once
    again = packed(docs).join(kept.filter("same > 1"), there).dropDuplicates(["id", "sha"])
    return once.unionByName(again.select("row.*"))
