"""Output names, rename plans and recycle destinations, set-based."""

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, naming, paths as p
from ..functions.let import once
from ..session import stored
from .hotkeys import running


def output_path(probes: DataFrame, target="av1+mkv", mode="keep", rewrite=True, tag=True,
                tag_token=fixed.REENCODE_TOKEN, name_suffix="", dotted=True,
                source_root=None, output_root=None) -> DataFrame:
    """Add `output_path`. keep/replace write beside the source, side under output_root."""
    if target not in fixed.TARGETS:
        raise ValueError(f"Unknown target {target!r}")
    if mode == "side" and not output_root:
        raise ValueError("side mode needs output_root")
    codec, ext = fixed.TARGETS[target]
    rows = p.with_path_parts(probes, prefix="__")
    if rewrite:
        rows = rows.withColumn("__stem", naming.rewrite_stem(F.col("__stem"), codec, dotted))
    if tag:
        rows = rows.withColumn("__stem", naming.append_token(
            F.col("__stem"), tag_token or fixed.REENCODE_TOKEN, True if rewrite and dotted else None))
    name = F.concat("__stem", F.lit(f"{name_suffix}.{ext}"))
    place = F.col("__dir")
    if mode == "side":
        base = output_root.rstrip("/")
        below = F.regexp_replace(F.col("__dir"), "^/+", "")
        if source_root is not None:
            rel = p.relative_dir(F.col("path"), source_root)
            below = F.when(p.under_root(F.col("path"), source_root), rel).otherwise(below)
        place = F.when(below == "", base).otherwise(F.concat(F.lit(base + "/"), below))
    return (rows.withColumn("output_path", p.join_path(place, name))
            .drop(*["__" + c for c in p.PARTS]))


def _tagged(listing: DataFrame, root=None) -> DataFrame:
    rows = listing if "stem" in listing.columns else p.with_path_parts(listing.select("path"))
    rows = rows.filter(
        F.lower("suffix").isin(fixed.VIDEO_EXTENSIONS) & p.has_reencode_marker(F.col("stem"))
        & ~p.any_dir_in(p.dirs_of(F.col("path"), root), fixed.SYSTEM_DIRS))
    rows = once(rows, new_stem=naming.rewrite_stem(F.col("stem")))
    return (rows.filter(F.col("new_stem") != F.col("stem"))
            .withColumn("new_path", p.join_path(F.col("dir"), F.concat("new_stem", "suffix"))))


def rename_plan(listing: DataFrame, root=None) -> DataFrame:
    """Tagged videos whose clean name differs and is free."""
    have = listing.select(F.col("path").alias("new_path")).distinct()
    return _tagged(listing, root).join(have, "new_path", "left_anti").select(
        "path", "new_path", "dir", "stem", "new_stem")


def rename_collisions(listing: DataFrame, root=None) -> DataFrame:
    have = listing.select(F.col("path").alias("new_path")).distinct()
    return _tagged(listing, root).join(have, "new_path", "left_semi").select("path", "new_path")


def rename_sidecars(listing: DataFrame, root=None) -> DataFrame:
    """Every file that moves with a planned video: same directory, same stem.

    One row per moving file, not per (video, file) pair. `blocked` marks files
    whose new name is taken. Paths are taken apart once; what follows reads the parts.
    """
    files = stored(p.with_path_parts(listing.select("path")), "rename-files")
    groups = rename_plan(files, root).select("dir", "stem", "new_stem").distinct()
    moves = files.join(groups, ["dir", "stem"]).withColumn(
        "new_path", p.join_path(F.col("dir"), F.concat("new_stem", "suffix")))
    have = files.select(F.col("path").alias("__have")).distinct()
    return (moves.join(have, F.col("new_path") == F.col("__have"), "left")
            .select("path", "new_path", F.col("__have").isNotNull().alias("blocked")))


def rename_conflicts(listing: DataFrame, root=None) -> DataFrame:
    """Planned moves that claim the same new name as another one."""
    moves = rename_sidecars(listing, root).select("path", "new_path")
    claims = (moves.groupBy(F.col("new_path").alias("__n")).agg(F.count(F.lit(1)).alias("n_claims"))
              .filter("n_claims > 1"))
    return (moves.join(claims, F.col("new_path") == F.col("__n"))
            .select("path", "new_path", "n_claims"))


_SLOT_CHUNK = 65536


def recycle_destination(sources: DataFrame, listing: DataFrame, recycle_to: str,
                        source_root: str | None = None, turn="turn") -> DataFrame:
    """Add `destination`: a free name under the recycle root for every source, no name twice.

    Sources that want one name take its free slots in `turn` order (path breaks ties): the name itself, then
    `_recycled1`, `_recycled2`, ... Slots already in the listing are passed over, and so is a slot that an earlier turn
    has taken as its own plain name, or the other way round: after each round, of two sources with one destination the
    later one's name counts that slot as held and is planned again; names that lost nothing keep their plan. Ranks are
    running counts over chunks, and chunks are ranges of the order itself, so a name wanted by very many sources is no
    problem, nor a turn that is the same for all or null.
    """
    base = recycle_to.rstrip("/")
    plain = F.concat(F.lit(base + "/"), p.file_name(F.col("path")))
    if source_root is not None:
        rel = F.substring(F.col("path"), F.lit(len(source_root.rstrip("/")) + 2), F.length("path"))
        plain = F.when(p.under_root(F.col("path"), source_root),
                       F.concat(F.lit(base + "/"), rel)).otherwise(plain)
    rows = sources.withColumn("__want", plain).repartitionByRange("__want", turn, "path")
    rows = stored(rows.withColumn("__chunk", F.spark_partition_id()), "recycle-sources")
    rows = running(rows, ["__want"], "__chunk", [turn, "path"], row_number="__r")
    # the source row rides along, so nothing is joined back
    rows = stored(rows.select("__want", (F.col("__r") - 1).alias("__v"), F.struct(*sources.columns).alias("__row")), "recycle-asks")

    # taken slots of every wanted name: slot 0 is the name itself
    held = p.with_path_parts(listing.select("path"))
    number = F.regexp_extract("stem", r"(?s)^.+_recycled([1-9]\d*)$", 1)
    root = F.regexp_replace("stem", r"(?s)_recycled[1-9]\d*$", "")
    taken = held.select(F.col("path").alias("__name"), F.lit(0).cast("long").alias("__slot")).unionByName(
        held.select(p.join_path(F.col("dir"), F.concat(root, F.col("suffix"))).alias("__name"),
                    number.try_cast("long").alias("__slot")).filter("__slot IS NOT NULL"))
    wanted = rows.select(F.col("__want").alias("__name")).distinct()
    taken = stored(taken.join(wanted, "__name", "left_semi").distinct(), "recycle-held")
    turn_of = F.struct(F.col(f"__row.{turn}").alias("t"), F.col("__row.path").alias("p"))
    plan = stored(_placed(rows, taken), "recycle-plan")
    while True:
        # only numbered slots and plain names that look like one can meet
        first = plan.groupBy("destination").agg(F.count(F.lit(1)).alias("claims"), F.min(turn_of).alias("first")).filter("claims > 1")
        lost = plan.join(first, "destination").filter(turn_of > F.col("first")).select(F.col("__want").alias("__name"), F.col("__v").alias("__slot"))
        lost = stored(lost.distinct(), "recycle-lost")
        if lost.isEmpty():
            return plan.select("__row.*", F.col("__v").alias("slot"), "destination")
        names = lost.select("__name").distinct()
        taken = taken.unionByName(lost)
        again = _placed(rows.join(names, F.col("__want") == F.col("__name"), "left_semi"), taken.join(names, "__name", "left_semi"))
        kept = plan.join(names, F.col("__want") == F.col("__name"), "left_anti")
        plan = kept.unionByName(stored(again, "recycle-again"))


def _placed(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Asks of rank __v per __want -> the slot that each one gets, and its name."""
    taken = taken.withColumn("__chunk", F.floor(F.col("__slot") / _SLOT_CHUNK))
    taken = running(taken, ["__name"], "__chunk", ["__slot"], row_number="__j")
    # free slots below a taken one; rank r lands at r + (taken with that many or fewer). Held slots are mostly
    # contiguous and then share one value, so they are counted before they move
    gaps = taken.groupBy("__name", (F.col("__slot") - F.col("__j") + 1).alias("__v")).agg(F.count(F.lit(1)).alias("__one"))
    gaps = gaps.withColumn("__kind", F.lit(0))
    asks = rows.select(F.col("__want").alias("__name"), "__v", F.lit(1).alias("__kind"), F.lit(0).cast("long").alias("__one"), "__row")
    both = gaps.unionByName(asks, allowMissingColumns=True).withColumn("__chunk", F.floor(F.col("__v") / _SLOT_CHUNK))
    both = running(both, ["__name"], "__chunk", ["__v", "__kind"], sums={"__skip": "__one"})
    out = both.filter("__kind = 1").select(
        F.col("__name").alias("__want"), "__row", (F.col("__v") + F.coalesce("__skip", F.lit(0))).alias("__v"))
    ext = p.suffix(p.file_name(F.col("__want")))
    numbered = F.concat(F.substring(F.col("__want"), F.lit(1), F.length("__want") - F.length(ext)),
                        F.lit("_recycled"), F.col("__v").cast("string"), ext)
    return out.withColumn("destination", F.when(F.col("__v") == 0, F.col("__want")).otherwise(numbered))
