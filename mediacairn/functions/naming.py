"""Name rewriting columns. The regex work is the cost: rewrite only rows that need it."""

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .let import let

_NOT_WORD_BEFORE, _NOT_WORD_AFTER, _WS = fixed.NOT_WORD_BEFORE, fixed.NOT_WORD_AFTER, fixed.WHITE_SPACE


def _token_regex(tokens, flags="(?iu)"):
    return flags + _NOT_WORD_BEFORE + "(?:" + "|".join(tokens) + ")" + _NOT_WORD_AFTER


def looks_dotted(stem: Column) -> Column:
    dots = F.length(stem) - F.length(F.replace(stem, F.lit("."), F.lit("")))
    spaces = F.length(stem) - F.length(F.regexp_replace(stem, "(?U)" + _WS, ""))
    return (dots > spaces) & (dots > 0)


def to_dotted(stem: Column) -> Column:
    out = F.regexp_replace(stem, r"(?U)(?:" + _WS + "|_)+", ".")
    return F.btrim(F.regexp_replace(out, r"\.{2,}", "."), F.lit("."))


def append_token(stem: Column, token: str, dotted: bool | None = None) -> Column:
    if not token:
        return stem
    if dotted is None:
        sep = F.when(looks_dotted(stem), ".").otherwise(" ")
    else:
        sep = F.lit("." if dotted else " ")
    return F.concat(stem, sep, F.lit(token))


def strip_foreign_tokens(stem: Column, codec: str) -> Column:
    tokens = fixed.FOREIGN_TOKENS.get(codec)
    return stem if not tokens else F.regexp_replace(stem, _token_regex(tokens), "")


def substitute_hdr_tokens(stem: Column, codec: str) -> Column:
    """First lost HDR/DV token becomes HDR10 unless HDR is named already; others go."""
    tokens = fixed.LOST_METADATA_TOKENS.get(codec)
    if not tokens:
        return stem
    any_lost = _token_regex(tokens)
    named = stem.rlike("(?iu)" + fixed.NAMES_HDR)
    first = F.regexp_replace(
        stem, "(?ius)^(.*?)" + _token_regex(tokens, flags=""), "$1HDR10")
    rest = F.regexp_replace(F.when(named, stem).otherwise(first), any_lost, "")
    return F.when(stem.rlike(any_lost), rest).otherwise(stem)


def cleanup_separators(stem: Column) -> Column:
    def clean(s):
        out = s
        for pattern, repl in fixed.SEPARATOR_STEPS:
            out = F.regexp_replace(out, "(?U)" + pattern, repl)
        # most stems hold nothing that any step looks for: one test settles those
        needed = s.rlike(r"(?U)\.\.|\.-|-\.|[\[(+]|" + _WS + r"[\s\x1c-\x1f.-]|[.-]" + _WS)
        return F.btrim(F.when(needed, out).otherwise(s), F.lit(" .-_+"))
    return let(stem, clean)


def has_codec_token(stem: Column, canonical: str) -> Column:
    return stem.rlike(_token_regex([canonical.replace(".", r"\.")]))


def rewrite_stem(stem: Column, codec: str = "av1", dotted: bool = True) -> Column:
    """The whole rewrite of one stem; an unknown codec changes nothing."""
    canonical = fixed.CANONICAL_TOKEN.get(codec)
    if canonical is None:
        return stem

    def finish(c):
        sep = F.lit(".") if dotted else F.when(looks_dotted(c), ".").otherwise(" ")
        named = (F.when(has_codec_token(c, canonical), c).when(c == "", canonical)
                 .otherwise(F.concat(c, sep, F.lit(canonical))))
        return cleanup_separators(to_dotted(named) if dotted else named)

    return let(strip_foreign_tokens(stem, codec), lambda bare: let(
        cleanup_separators(substitute_hdr_tokens(bare, codec)), finish))


def rewrite_name(df: DataFrame, stem: str, out: str, codec: str = "av1",
                 dotted: bool = True) -> DataFrame:
    """Add column `out` with the rewritten stem."""
    return df.withColumn(out, rewrite_stem(F.col(stem), codec, dotted))
