"""Plan gate, candidates and queue."""

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed, gate as g, naming, outcomes, paths as p, probe as pr, rules as r
from ..functions.let import once
from .hotkeys import numbered

GATES = ["missing", "stalled", "dv", "reencoded", "existing_output", "av1_source",
         "skipped_codec", "low_bitrate", "extras", "ok"]


def covering_roots(probes: DataFrame, roots: DataFrame) -> DataFrame:
    """probes inside any of the roots, with the columns of the deepest root that holds them.

    roots: root (unique), and what else belongs to it. A path's own ancestors, a handful, meet the roots by equality, so
    many roots cost no more than one, and a root never takes a neighbour whose name only starts alike.
    """
    asked = roots.select(F.regexp_replace("root", "(?<=.)/+$", "").alias("__root"), F.struct("*").alias("__r"))
    parts = F.split(F.col("path"), "/")
    # "/", "/a", "/a/b", ... up to the path itself: a root may be a file
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = probes.select(F.struct("*").alias("__p"), F.explode(F.transform(above, lambda a: F.when(a == "", "/").otherwise(a))).alias("__root"))
    deepest = F.max_by(F.struct("__p", "__r"), F.length("__root"))
    held = rows.join(asked, "__root").groupBy(F.col("__p.path").alias("__path")).agg(deepest.alias("__b"))
    extra = [F.col("__b.__r")[c].alias(c) for c in roots.columns]
    return held.select(*[F.col("__b.__p")[c].alias(c) for c in probes.columns], *extra)


def path_scope(df: DataFrame, root: str | None) -> DataFrame:
    return df if root is None else df.filter(p.under_root(F.col("path"), root))


def stall_strikes(decisions: DataFrame) -> DataFrame:
    """Stall failures per path. Counts shrink in each task before the shuffle."""
    return (decisions.filter(outcomes.is_stall_failure())
            .groupBy("path").agg(F.count(F.lit(1)).alias("strikes")))


def _output_beside(rows: DataFrame, out: str, wanted) -> DataFrame:
    """Add `out`: where a finished encode would be, null where `wanted` is false.

    Needs __dir and __stem. Only wanted stems are rewritten.
    """
    stem = naming.rewrite_stem(F.when(wanted, F.col("__stem")))
    return once(rows, **{out: p.join_path(
        F.col("__dir"), F.concat(stem, F.lit(f".{fixed.REENCODE_TOKEN}.mkv")))})


def expected_output(df: DataFrame) -> DataFrame:
    """Add `expected_path`, the name a finished encode would have beside the source.

    Null where the source is itself an output.
    """
    rows = p.with_path_parts(df, prefix="__")
    rows = _output_beside(rows, "expected_path", ~p.has_reencode_word(F.col("__stem")))
    return rows.drop(*["__" + c for c in p.PARTS])


def existing_output(probes: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources whose finished output is already listed (unfiltered listing)."""
    have = listing.select(F.col("path").alias("expected_path")).distinct()
    return (expected_output(probes).filter(F.col("expected_path") != F.col("path"))
            .join(have, "expected_path", "left_semi"))


def plan_gate(probes: DataFrame, listing: DataFrame, decisions: DataFrame,
              allow_reencoded=False, allow_av1=False, allow_extras=False,
              allow_low_bitrate=False, skip_codecs=()) -> DataFrame:
    """Add `gate`: the first reason to leave a file out, or ok.

    Joins on path keep one shuffle of the probes for listing and strikes; the
    output-name join is the only other one.
    """
    listed = listing.select(F.col("path").alias("__l")).distinct()
    strikes = stall_strikes(decisions).select(F.col("path").alias("__sp"), "strikes")
    rows = (probes.join(listed, F.col("path") == F.col("__l"), "left")
            .join(strikes, F.col("path") == F.col("__sp"), "left"))
    rows = p.with_path_parts(rows, prefix="__").withColumn(
        "__tagged", p.has_reencode_word(F.col("__stem")))
    if not allow_reencoded:
        rows = _output_beside(rows, "__want", ~F.col("__tagged") & F.col("__l").isNotNull())
        # a row with no output name keeps its own path as key: it matches nothing
        # (see the condition) and keyless rows do not pile up in one task
        rows = rows.withColumn("__want", F.coalesce("__want", "path"))
        have = listing.select(F.col("path").alias("__out")).distinct()
        rows = rows.join(have, (F.col("__want") == F.col("__out"))
                         & (F.col("__out") != F.col("path")), "left")
    codec = r.codec()
    skip = [s.strip().lower() for s in skip_codecs if s.strip()]
    chain = (F.when(F.col("__l").isNull(), "missing")
             .when(F.col("strikes") >= fixed.STALL_LIMIT, "stalled")
             .when(g.dv_blocked(F.col("dv_profile")), "dv"))
    if not allow_reencoded:
        chain = (chain.when(F.col("__tagged"), "reencoded")
                 .when(F.col("__out").isNotNull(), "existing_output"))
    if not allow_av1:
        chain = chain.when(codec == "av1", "av1_source")
    if skip:
        chain = chain.when(codec.isin(skip), "skipped_codec")
    if not allow_low_bitrate:
        chain = chain.when(g.below_target_bitrate(F.col("video_bitrate"), F.col("height")),
                           "low_bitrate")
    if not allow_extras:
        chain = chain.when(p.has_extras_suffix(F.col("__stem")), "extras")
    return rows.select(*probes.columns, chain.otherwise("ok").alias("gate"))


def plan_skip_counts(probes, listing, decisions, scope=None, **flags) -> DataFrame:
    """Rows per skip reason, with out_of_scope for files outside the root."""
    gated = plan_gate(path_scope(probes, scope), listing, decisions, **flags)
    counts = gated.filter("gate <> 'ok'").groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    if scope is None:
        return counts
    outside = probes.filter(~p.under_root(F.col("path"), scope)).groupBy(
        F.lit("out_of_scope").alias("gate")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(outside)


def candidates(probes: DataFrame, enabled=None, target="av1+mkv") -> DataFrame:
    """Files with at least one firm verdict, with savings and the remux flag."""
    rows = r.evaluate_rules(probes.filter(r.any_firm(enabled)), enabled)
    return (rows.withColumn("rules_fired", r.firm_names(F.col("fired")))
            .withColumn("target", F.lit(target))
            .withColumn("remux_only", r.remux_only(F.col("rules_fired"), F.col("video_codec")))
            .withColumn("projected_savings_mb", r.projected_savings(F.col("fired"))))


def queue_candidates(probes: DataFrame, enabled=None, target="av1+mkv") -> DataFrame:
    """The same files, rules and savings as `candidates`, without reasons and notes.

    What a queue needs. Texts and maps per verdict are most of the cost of a
    plan over a large library.
    """
    rows = (probes.filter(r.any_firm(enabled))
            .withColumn("rules_fired", r.rules_fired(enabled))
            .withColumn("projected_savings_mb", r.capped_savings(r.best_savings(enabled))))
    return (rows.withColumn("target", F.lit(target))
            .withColumn("remux_only", r.remux_only(F.col("rules_fired"), F.col("video_codec"))))


def pending_rows(cands: DataFrame, run_id: int, decided_at: float) -> DataFrame:
    """Rows of a plan, not stored yet: without ids, which `pending_replace` gives."""
    return cands.select(
        F.lit(None).cast("long").alias("id"), "path",
        F.lit(float(decided_at)).alias("decided_at"), "rules_fired", "target",
        "projected_savings_mb", F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("output_path"),
        F.lit(None).cast("double").alias("actual_savings_mb"),
        F.lit(None).cast("string").alias("error"), F.lit(run_id).cast("long").alias("run_id"))


def pending_replace(decisions: DataFrame, fresh: DataFrame, last_id: int = 0) -> DataFrame:
    """Drop every pending row, whatever its scope, then add the new ones with ids above all that were ever given.

    Ids rise by path from the largest of the ledger on, pending rows that go included, so that an id held elsewhere
    never comes to mean another row. last_id: the highest id given so far, where the ledger may have lost it.
    """
    top = decisions.agg(F.max("id")).first()[0]
    rows = numbered(fresh.drop("id"), ["path"], "id", max(top or 0, last_id))
    return decisions.filter(F.col("status") != "pending").unionByName(rows.select(*decisions.columns))


def rank_queue(decisions: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending rows, largest projected savings first; path, then id break ties."""
    ranked = (decisions.filter(F.col("status") == "pending")
              .orderBy(F.coalesce("projected_savings_mb", F.lit(0.0)).desc(), "path", "id"))
    return ranked.limit(limit) if limit else ranked


def height_band(decisions: DataFrame, probes: DataFrame, min_height=None, max_height=None) -> DataFrame:
    """Decisions whose file lies in the band; one without a probe stays.

    Written as "no probe outside the band", so only out-of-band paths travel.
    """
    if min_height is None and max_height is None:
        return decisions
    outside = F.lit(False)
    if min_height is not None:
        outside = outside | (F.col("height") < min_height)
    if max_height is not None:
        outside = outside | (F.col("height") > max_height)
    return decisions.join(probes.filter(outside).select("path"), "path", "left_anti")


def apply_queue(decisions, probes, min_height=None, max_height=None, limit=None) -> DataFrame:
    """Filter by band, then order, then cut: a limit counts files in the band."""
    return rank_queue(height_band(decisions, probes, min_height, max_height), limit)


def plan_summary(probes, listing, decisions, scope=None, enabled=None, **flags) -> DataFrame:
    """One row per outcome: every gate, candidates, files with no rule, cleared pending."""
    scoped = plan_gate(path_scope(probes, scope), listing, decisions, **flags)
    outcome = (F.when(F.col("gate") != "ok", F.col("gate"))
               .when(r.any_firm(enabled), "candidate").otherwise("no_rule"))
    counts = scoped.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    cleared = decisions.filter("status = 'pending'").groupBy(
        F.lit("cleared_pending").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.unionByName(cleared)
    if scope is not None:
        out = out.unionByName(probes.filter(~p.under_root(F.col("path"), scope)).groupBy(
            F.lit("out_of_scope").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))
    return out


def rule_mix(probes: DataFrame, enabled=None) -> DataFrame:
    """Candidates and savings by fired rule. At most one group per rule."""
    rows = probes.filter(r.any_firm(enabled)).select(
        r.capped_savings(r.best_savings(enabled)).alias("projected_savings_mb"),
        F.explode(r.rules_fired(enabled, advisory=True)).alias("rule"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n_candidates"),
                                    F.sum("projected_savings_mb").alias("savings_mb"))


def preset_resolve(probes: DataFrame, film=False, quality=None, keep_langs=None,
                   min_height=None, max_height=None, hw_decode=None) -> DataFrame:
    """Preset per file by height band; an explicit value wins over the preset's."""
    name = F.col("preset")

    def pick(explicit, field, kind):
        own = g.preset_value(name, field, kind)
        return own if explicit is None else F.lit(explicit).cast(kind)
    rows = probes.withColumn("preset", g.preset_of_height(F.col("height"), film))
    return (rows.withColumn("preset_target", g.preset_value(name, "target", "string"))
            .withColumn("quality", pick(quality, "quality", "int"))
            .withColumn("encoder_preset", g.preset_value(name, "encoder_preset", "string"))
            .withColumn("keep_langs", pick(keep_langs, "keep_langs", "string"))
            .withColumn("min_height", pick(min_height, "min_height", "int"))
            .withColumn("max_height", pick(max_height, "max_height", "int"))
            .withColumn("hw_decode", pick(hw_decode, "hw_decode", "boolean")))


def tier_time_estimate(decisions: DataFrame, probes: DataFrame) -> DataFrame:
    """Files and seconds per tier, plus a total row.

    Pending rows are counted per path before the join, so a path with many
    rows does not weigh on it. No probe counts as SD.
    """
    pending = (decisions.filter("status = 'pending'").groupBy("path")
               .agg(F.count(F.lit(1)).alias("__n")))
    rows = pending.join(probes.select("path", "height"), "path", "left")
    tier = pr.tier_of_height(F.col("height"))
    secs = r._lookup(F.col("tier"), fixed.SECONDS_PER_FILE, "long")
    return (rows.groupBy(tier.alias("tier")).agg(F.sum("__n").alias("n_files"))
            .withColumn("seconds", F.col("n_files") * secs)
            .rollup("tier").agg(F.sum("n_files").alias("n_files"), F.sum("seconds").alias("seconds"))
            .select(F.coalesce("tier", F.lit("total")).alias("tier"), "n_files", "seconds"))


def job_flags(probes: DataFrame, film=False, explicit_timeout=None) -> DataFrame:
    """Preset values plus denoise, decode path and time limit per file."""
    rows = preset_resolve(probes, film)
    rows = rows.withColumn("denoise", g.denoise_flag(
        F.col("height"), F.col("video_codec"), F.col("video_bitrate")))
    return (rows.withColumn("hw_decode", g.hw_decode_flag(
                F.col("hw_decode"), F.col("video_codec"), F.col("denoise")))
            .withColumn("timeout_s", g.encode_timeout(F.col("duration_seconds"), explicit_timeout)))
