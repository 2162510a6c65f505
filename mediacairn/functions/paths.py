"""Path columns: name, parent, stem, suffix, tail, component-wise scope."""

from pyspark.sql import Column, functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    cut = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return (F.when(F.instr(path, "/") == 0, F.lit("."))
            .when(cut == "", F.lit("/")).otherwise(cut))


def suffix(name: Column) -> Column:
    """Last extension with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def last_two_parts(path: Column) -> Column:
    clean = F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(F.instr(clean, "/") > 0, F.substring_index(clean, "/", -2)).otherwise(path)


def with_path_parts(df, path="path", prefix=""):
    """Add dir, name, stem and suffix (with a prefix). Split once per row."""
    n, x = prefix + "name", prefix + "suffix"
    return (df.withColumn(prefix + "dir", parent_dir(F.col(path)))
            .withColumn(n, file_name(F.col(path)))
            .withColumn(x, suffix(F.col(n)))
            .withColumn(prefix + "stem", F.substring(
                F.col(n), F.lit(1), F.length(n) - F.length(x))))


PARTS = ["dir", "name", "suffix", "stem"]


def join_path(directory: Column, name: Column) -> Column:
    return F.concat(F.when(directory == "/", "").otherwise(directory), F.lit("/"), name)


def under_root(path: Column, root: str) -> Column:
    """Equal to the root or below it, by path component."""
    base = root.rstrip("/")
    if not base:
        return path.startswith("/")
    return (path == base) | path.startswith(base + "/")


def relative_dir(path: Column, root: str) -> Column:
    """Directories between the root and the file, '' when directly in the root."""
    base = root.rstrip("/")
    below = F.substring(path, F.lit(len(base) + 2), F.length(path))
    return F.regexp_extract(below, r"(?s)^(.*)/[^/]*$", 1)


def dirs_of(path: Column, root: str | None) -> Column:
    """Directories that count for dir filters: below the root, or all without one."""
    return parent_dir(path) if root is None else relative_dir(path, root)


def any_dir_in(rel_dir: Column, names) -> Column:
    return F.arrays_overlap(F.split(rel_dir, "/"), F.array(*[F.lit(n) for n in names]))


def has_extras_suffix(stem_col: Column) -> Column:
    from .fixed import EXTRAS_SUFFIXES
    return F.lower(stem_col).rlike("-(" + "|".join(EXTRAS_SUFFIXES) + r")\z")


def has_reencode_word(stem_col: Column) -> Column:
    r"""`\bREENCODE\b`, any case: `_` counts as a word character."""
    return stem_col.rlike(r"(?iU)\bREENCODE\b")


def has_reencode_marker(stem_col: Column) -> Column:
    """REENCODE with no ASCII letter or digit beside it: `_` may touch it."""
    return stem_col.rlike(r"(?iu)(?<![A-Za-z0-9])REENCODE(?![A-Za-z0-9])")
