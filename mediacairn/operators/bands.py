"""Bands of a number, given as a table: range joins by bins, without a nested loop.

bands: name, min_height, max_height (inclusive; null: open), place (the smaller place wins where bands overlap; ties: the
smaller name), and what else a band carries. Bands are first cut into segments that don't overlap, each with the band
that wins there; segments are dealt into bins of BIN, and a row meets the few segments of its bin by equality. So the
large side is joined once, keeps its rows, and is never multiplied by overlapping bands.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

BIN, TOP = 120, 100  # bins of 120 lines; the last one, from 12000 up, is open


def bin_of(value):
    return F.least(F.greatest(F.floor(value / BIN), F.lit(-1)), F.lit(TOP)).cast("int")


def segments(bands: DataFrame) -> DataFrame:
    """bin, low, high (exclusive, null: open), win (the winning band's columns): no two overlap. -1 is the bin below 0."""
    low = F.coalesce(F.col("min_height").cast("long"), F.lit(-2**62))
    high = F.coalesce(F.col("max_height").cast("long") + 1, F.lit(2**62))
    cut = (bands.select(F.struct("*").alias("band"), low.alias("low"), high.alias("high")).filter("low < high")
           .withColumn("bin", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high") - 1)))))
    # inside a bin every end of a band is an edge; between two edges the same bands hold
    edges = cut.select("bin", F.explode(F.array("low", "high")).alias("low")).distinct()
    spans = edges.withColumn("high", F.lead("low").over(W.partitionBy("bin").orderBy("low"))).filter("high IS NOT NULL")
    s, c = spans.alias("s"), cut.alias("c")
    covered = s.join(c, (F.col("s.bin") == F.col("c.bin")) & (F.col("c.low") <= F.col("s.low")) & (F.col("s.low") < F.col("c.high")))
    return (covered.groupBy("s.bin", "s.low", "s.high")
            .agg(F.min_by("band", F.struct("band.place", "band.name")).alias("win")))


def with_band(rows: DataFrame, bands: DataFrame, value="height") -> DataFrame:
    """rows, and for each the winning band's columns; null where no band holds the value or it is null."""
    wide = segments(bands).withColumnsRenamed({"bin": "__bin", "low": "__low", "high": "__high", "win": "__win"})
    v = F.col(value).cast("long")
    met = (bin_of(v) == F.col("__bin")) & (v >= F.col("__low")) & (v < F.col("__high"))
    extra = [c for c in bands.columns if c not in ("name", "place")]
    return rows.join(wide, met, "left").select(
        *rows.columns, F.col("__win.name").alias("preset"), *[F.col(f"__win.{c}").alias(c) for c in extra if c not in rows.columns])
