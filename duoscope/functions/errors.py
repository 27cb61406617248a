"""Error codes with their status; bad rows go to a table of errors instead of failing a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The codes and their status.
STATUS = {
    "api_error": 400,
    "invalid_question": 422,
    "unreadable_upload": 422,
    "unnamed_upload": 422,
    "empty_artifact": 422,
    "invalid_request": 422,
    "upload_too_large": 413,
    "artifacts_too_large_to_compare": 413,
    "request_too_large": 413,
    "internal_error": 500,
    "generation_unavailable": 503,
}


def status_code(code: Column) -> Column:
    """The status of a code; 400 for one that isn't known, null for null."""
    known = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(known, code), F.lit(STATUS["api_error"])))


def errors_table(rows: DataFrame, key: str, code: str = "error_code", message: Column | None = None) -> DataFrame:
    """(key, status_code, error_code, error_message) of the rows that have a code."""
    text = F.lit(None).cast("string") if message is None else message
    return rows.filter(F.col(code).isNotNull()).select(key, status_code(F.col(code)).alias("status_code"), F.col(code).alias("error_code"), text.alias("error_message"))
