"""Mixing sources to target weights by systematic sampling.

Documents of a source lie on a line in order of their size; each takes as much of it as the copies expected of it. One
random offset per source shifts the line, and a document is emitted once for every integer boundary it crosses. As
neighbours are alike in size, the words taken come close to the target, not only the documents.

A prefix sum over a source that holds much of the table is put together from three levels, each small: sizes within a
source, salts within a size, rows within a salt. Only the first two are summed over whole keys, on counted rows.

Targets: sources by code point, null last, weigh 3, 1, 2 and so on; they share `share` of all words by weight, none more
than `most` times its own, the excess shared again by weight. That is one water level over all sources: the largest of
the levels at which the sources below it are full.

Nulls and empties: a null text has no words; documents without words count as copies but weigh nothing. A null source is
a source of its own, apart from an empty name. A null doc_id comes first in its salt. Rows that repeat an id are rows of
their own. An empty table gives an empty result.
"""

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import packed, stored, work_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
ROWS_A_SALT = 100_000
SEED = "mix-1"


def word_count(text) -> Column:
    """Longest runs of what is not 0x20 or 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def offset(source) -> Column:
    """The random offset of a source, 0 to 1: the same in every run."""
    digest = F.md5(F.concat(F.lit(SEED), F.when(source.isNull(), F.lit("?")).otherwise(F.concat(F.lit(":"), source))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def targets(words: DataFrame, share=SHARE, weights=WEIGHTS, most=MOST) -> DataFrame:
    """(source, source_size) -> source, source_size, target. One row per source, so one task."""
    everyone = W.partitionBy(F.lit(0))
    by_name = everyone.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = words.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most))
    filling = everyone.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(everyone) * float(share)
    level = weighed.withColumn("level", (total - full) / open_)
    return (level.withColumn("level", F.max("level").over(everyone))
            .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target")))


def mixed(docs: DataFrame, share=SHARE, weights=WEIGHTS, most=MOST, rows_a_salt=ROWS_A_SALT) -> DataFrame:
    """Every row of `docs` as `row`, with size, source_size, target and copies (0 to ceil(most))."""
    # null source and empty name are told apart by a prefix
    name = lambda source: F.coalesce(F.concat(F.lit(":"), source), F.lit("?"))
    salts = F.lit(max(1, -(-docs.count() // rows_a_salt)))
    rows = packed(docs).select("row", word_count(F.col("row.text")).alias("size"), name(F.col("row.source")).alias("name"),
                               F.pmod(F.coalesce("row.doc_id", F.lit(0)), salts).alias("salt"))
    counts = stored(rows.groupBy("name", "size", "salt").agg(F.first("row.source").alias("source"), F.count(F.lit(1)).alias("n")),
                    work_dir(docs.sparkSession, "mix-counts"))
    sizes = counts.groupBy("name", "size").agg(F.first("source").alias("source"), F.sum("n").alias("n"))
    goal = targets(sizes.groupBy("name").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
                   .select("source", "source_size"), share, weights, most)
    goal = goal.select(name(F.col("source")).alias("name"), F.col("source_size").alias("source_size"), F.col("target").alias("target"),
                       F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("expected"), offset(F.col("source")).alias("offset"))
    up_to = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    below = sizes.select("name", "size", F.coalesce(F.sum("n").over(up_to(W.partitionBy("name").orderBy("size"))), F.lit(0)).alias("below"))
    beside = counts.select("name", "size", "salt", F.coalesce(
        F.sum("n").over(up_to(W.partitionBy("name", "size").orderBy("salt"))), F.lit(0)).alias("beside"))
    start = (beside.join(below, ["name", "size"]).join(goal, "name")
             .withColumn("start", F.col("below") + F.col("beside")).drop("below", "beside"))
    inside = F.row_number().over(W.partitionBy("name", "size", "salt").orderBy("row.doc_id", F.xxhash64("row.text"))) - 1
    placed = rows.withColumn("inside", inside).join(start, ["name", "size", "salt"])
    rank = F.col("start") + F.col("inside")
    edge = lambda r: F.floor(F.col("expected") * r + F.col("offset"))
    copies = F.least(edge(rank + 1) - edge(rank), F.lit(math.ceil(most)))
    return placed.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix: rows of `docs`, all columns, each as often as it is drawn."""
    drawn = mixed(docs, **how).filter("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
