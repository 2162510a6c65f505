"""Ledger text and status columns."""

from pyspark.sql import Column, functions as F

from . import fixed


def is_stall_failure() -> Column:
    """Failed with a stall text. The match ignores case."""
    return F.coalesce((F.col("status") == "failed")
                      & F.col("error").ilike(f"%{fixed.STALL_MARK}%"), F.lit(False))


def error_token(error: Column) -> Column:
    low = F.lower(error)
    chain = F.lit(fixed.ERROR_TOKEN_DEFAULT)
    for needle, token in reversed(fixed.ERROR_TOKENS):
        chain = F.when(low.contains(needle), token).otherwise(chain)
    return chain


def classify_decision(status: Column, output_path: Column) -> Column:
    has_output = F.coalesce(output_path, F.lit("")) != ""
    return (F.when((status == "completed") & has_output, "ok")
            .when(status == "failed", "fail").when(status == "skipped", "skip")
            .when(status == "pending", "dry").otherwise("other"))


def whole_mb(mb: Column) -> Column:
    return F.coalesce(F.bround(mb, 0), F.lit(0)).cast("long")


def report_line(cls: Column) -> Column:
    token = error_token(F.col("error"))
    return (F.when(cls == "ok", F.concat_ws(
                "\t", F.lit("OK"), whole_mb(F.col("actual_savings_mb")).cast("string"),
                F.col("output_path"), F.col("path")))
            .when(cls == "fail", F.concat_ws("\t", F.lit("FAIL"), token, F.col("path")))
            .when(cls == "skip", F.concat_ws("\t", F.lit("SKIP"), token, F.col("path")))
            .when(cls == "dry", F.concat_ws("\t", F.lit("DRY"), F.lit("dry-run"), F.col("path"))))


def section_order(cls: Column) -> Column:
    return F.when(cls == "ok", 0).when(cls == "fail", 1).when(cls == "skip", 2).when(cls == "dry", 3)
