"""Running values per key that survive a key holding much of the data.

A plain window sends every row of a key to one task. Here each key is cut into
chunks by a column that rises with the order; windows run inside (key, chunk),
and only one summary row per chunk goes through a window over the whole key.
"""

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType, VariantType

from ..session import stored


def running(df: DataFrame, keys, chunk, order, row_number=None, sums=None, maxes=None,
            lasts=None, previous_only=(), attributes=None) -> DataFrame:
    """Add running columns over `keys` in `order`: a segmented scan that reads its input once.

    chunk          column name; must never fall as `order` rises inside a key
    row_number     name of a 1-based rank column to add
    sums/maxes     {new column: source column}, running sum / max
    lasts          {new column: source column}, last non-null value so far
    previous_only  new columns that exclude the current row
    attributes     table with `keys` and further columns, one row per key; added to every row of the key (null if it has none)

    The last row of a (key, chunk) after the windows inside it *is* the chunk's summary. Summaries, and the attributes
    as a segment before them all, go through one window over the key; what they carry goes back to (key, chunk), where
    the rows still are. So rows are exchanged once, and only summaries twice more. Ties in `order` are broken by the
    other columns, which also keeps both readers of the exchanged rows on the same columns, so that they share it
    (a column that can't be sorted, a map, costs a second read).
    """
    keys, order, columns = list(keys), list(order), df.columns
    sums, maxes, lasts = sums or {}, maxes or {}, lasts or {}
    df, own = never_null(df, keys, "__k")
    df, piece = never_null(df, [chunk], "__p")
    part = own + piece
    ties = [f.name for f in df.schema.fields if f.name in columns and f.name not in order and sortable(f.dataType)]
    inside = W.partitionBy(*part).orderBy(*order, *ties)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*own).orderBy("__real", chunk).rowsBetween(W.unboundedPreceding, -1)

    local, totals, carries, finals = [], {}, [], {}

    def value(new, fn, carry, join):
        """fn(): what is counted up; carry: how summaries add up; join(l, c): local value and carry."""
        local.append(fn().over(before if new in previous_only else upto).alias("__l_" + new))
        total = "__l_" + new
        if new in previous_only:
            total = "__t_" + new
            local.append(fn().over(upto).alias(total))
        totals[new] = total
        carries.append(carry(total).over(earlier).alias("__c_" + new))
        finals[new] = join(F.col("__l_" + new), F.col("__c_" + new))

    def added(l, c):
        return F.when(l.isNull(), c).when(c.isNull(), l).otherwise(l + c)
    if row_number:
        value(row_number, lambda: F.count(F.lit(1)), F.sum, lambda l, c: (l + F.coalesce(c, F.lit(0))).cast("long"))
    for new, src in sums.items():
        value(new, lambda src=src: F.sum(src), F.sum, added)
    for new, src in maxes.items():
        value(new, lambda src=src: F.max(src), F.max, F.greatest)
    for new, src in lasts.items():
        value(new, lambda src=src: F.last(src, ignorenulls=True), lambda t: F.last(t, ignorenulls=True), F.coalesce)

    windowed = df.select("*", *local, F.lead(F.lit(True)).over(inside).isNull().alias("__last"))
    summary = windowed.filter("__last").select(*part, chunk, F.lit(1).alias("__real"), *dict.fromkeys(totals.values()))
    extra = [c for c in attributes.columns if c not in keys] if attributes is not None else []
    if extra:
        first = never_null(attributes, keys, "__k")[0].select(*own, F.lit(0).alias("__real"), F.struct(*extra).alias("__a"))
        summary = summary.unionByName(first, allowMissingColumns=True)
        carries.append(F.first("__a", ignorenulls=True).over(earlier).alias("__c_a"))
    carried = (summary.select(*part, "__real", *carries).filter("__real = 1").drop("__real")
               .withColumnsRenamed({c: "__j_" + c for c in part}))
    on = [F.col(c) == F.col("__j_" + c) for c in part]
    return windowed.join(carried, on, "left").select(
        *columns, *[v.alias(n) for n, v in finals.items()], *[F.col("__c_a")[c].alias(c) for c in extra])


def never_null(df: DataFrame, names, prefix):
    """(df with stand-ins for columns that may be null, names to group by instead).

    Null keys are keys like others; and a join on columns that are never null asks for no filter below its exchange.
    """
    out, use = df, []
    for i, c in enumerate(names):
        field = df.schema[c]
        if isinstance(field.dataType, NumericType):
            stand = F.coalesce(F.col(c), F.lit(0).cast(field.dataType))
        else:
            stand = F.coalesce(F.col(c).cast("string"), F.lit(""))
        out = out.withColumn(f"{prefix}{i}", stand).withColumn(f"{prefix}{i}_null", F.col(c).isNull())
        use += [f"{prefix}{i}", f"{prefix}{i}_null"]
    return out, use


def sortable(kind) -> bool:
    """Can a window be ordered by this type?"""
    if isinstance(kind, ArrayType):
        return sortable(kind.elementType)
    if isinstance(kind, StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def latest_per_key(df: DataFrame, keys, version) -> DataFrame:
    """One row per key: the one with the largest `version` columns.

    An aggregate, so partial results shrink the data before the shuffle and a
    key with many versions never gathers in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*version))
    return (df.groupBy(*keys).agg(newest.alias("__v"))
            .select(*keys, *[F.col("__v")[c].alias(c) for c in rest])
            .select(*df.columns))


def first_rows(df: DataFrame, keys, order, n) -> DataFrame:
    """First n rows per key. Spark cuts to n per key in each task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)


def numbered(df: DataFrame, order, name, after=0) -> DataFrame:
    """Add `name`: after + 1, after + 2, ... in `order`, which must be total.

    Rows are sorted by ranges and written; a row's place in its range and the sizes of the ranges before it make its
    number. One number for each range is all that comes together, and a rerun numbers alike, wherever ranges are cut.
    """
    low = 33  # monotonically_increasing_id: partition above, place in it below
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", low)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", (before + F.lit(after)).alias("__start"))
    number = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << low) - 1)) + 1
    return (rows.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row for each range
            .select(*df.columns, number.cast("long").alias(name)))
