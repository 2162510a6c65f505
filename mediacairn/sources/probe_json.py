"""Probe documents as JSON: reading, error side, round trip."""

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import probe as pr


def parse_probe_text(df: DataFrame, doc="doc") -> DataFrame:
    """Replace the JSON text column by format, streams and corrupt (text when bad)."""
    parsed = F.from_json(F.col(doc), schemas.PROBE_DOC + ", corrupt string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return df.select(*[c for c in df.columns if c != doc], _parse_once(parsed))


def _parse_once(parsed):
    """The fields of a parsed text as columns, parsed once per row.

    As a plain projection the optimizer would copy the parse into every field
    and filter that uses it; a generator keeps it in one place.
    """
    return F.inline(F.array(parsed))


def _bad_number(text, kind):
    return text.isNotNull() & (text != "") & text.try_cast(kind).isNull()


def tag_probe_errors(docs: DataFrame) -> DataFrame:
    """Add `reason`, null for good documents. Nothing fails the job."""
    video = pr.primary_video(F.col("streams"))
    fmt = F.col("format")
    reason = (F.when(F.col("corrupt").isNotNull(), "not json")
              .when(video.isNull(), "no video stream")
              .when(_bad_number(fmt["duration"], "double"), "bad number")
              .when(_bad_number(fmt["size"], "bigint"), "bad number")
              .when(_bad_number(video["width"], "int"), "bad number")
              .when(_bad_number(video["height"], "int"), "bad number"))
    return docs.withColumn("reason", reason)


def split_probe_errors(docs: DataFrame):
    """(good documents, errors with a reason). Readers of both sides store the tagged table first."""
    tagged = tag_probe_errors(docs)
    good = tagged.filter(F.col("reason").isNull()).drop("reason", "corrupt")
    return good, tagged.filter(F.col("reason").isNotNull()).drop("format", "streams", "corrupt")


def probes_to_json(probes: DataFrame) -> DataFrame:
    """path and one JSON text per probe."""
    return probes.select("path", F.to_json(F.struct(*[
        c for c in probes.columns if c != "last_probed_at"])).alias("probe_json"))


def probes_from_json(texts: DataFrame, keep=()) -> DataFrame:
    """Inverse. Fields absent from older text come back null, lists empty. keep: columns to carry along."""
    rows = texts.select(*keep, _parse_once(F.from_json("probe_json", schemas.PROBE)))
    for c in ("audio_tracks", "subtitle_tracks"):
        rows = rows.withColumn(c, F.coalesce(c, F.array().cast(rows.schema[c].dataType)))
    return rows
