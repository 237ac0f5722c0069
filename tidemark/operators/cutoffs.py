"""What changed since a training cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Approximate training cutoffs by part of a model's name.
CUTOFFS = {
    "claude-opus-4-8": "2026-01-01", "claude-opus-4": "2025-10-01", "claude-sonnet-4": "2025-08-01", "claude-haiku-4": "2025-08-01", "claude-3-5-sonnet": "2024-04-01",
    "claude-3": "2023-08-01", "gpt-4o": "2024-06-01", "gpt-4.1": "2024-06-01", "gpt-4-turbo": "2023-12-01", "gpt-4": "2023-09-01", "o1": "2024-10-01", "o3": "2025-01-01",
    "gemini-2": "2025-01-01", "gemini-1.5": "2024-04-01", "llama-3": "2023-12-01",
}


def registry(spark: SparkSession) -> DataFrame:
    """(model_key, cutoff)."""
    return spark.createDataFrame(list(CUTOFFS.items()), "model_key string, cutoff string")


def cutoff_of(model: Column | str) -> Column:
    """Date of the longest key that the name holds, without regard to case; null for unknown and null names.

    The registry is 15 rows of constants, so the lookup is an expression and not a join by containment.
    """
    low = F.lower(F.col(model) if isinstance(model, str) else model)
    found = F.lit(None).cast("string")
    for key in sorted(CUTOFFS, key=len):
        found = F.when(F.contains(low, F.lit(key)), F.lit(CUTOFFS[key])).otherwise(found)
    return found


def since_ms(since: Column, model: Column) -> Column:
    """struct<since_ms, error>: an ISO date wins over the model; an unreadable date or unknown model is an error."""
    date = F.try_to_timestamp(since)
    known = F.try_to_timestamp(cutoff_of(model))
    given = since.isNotNull() & (since != "")
    return F.struct(F.unix_millis(F.when(given, date).otherwise(known)).alias("since_ms"), F.when(given & date.isNull(), "invalid date").when(~given & known.isNull(), "unknown model").alias("error"))


def changes_since(versions: DataFrame, key: str, digest: str, at: str, since: int) -> DataFrame:
    """(key, changes, latest): versions strictly newer than the cutoff and the newest of them."""
    newer = versions.filter(F.col(at) > since)
    return newer.groupBy(key).agg(F.count("*").alias("changes"), F.max_by(digest, F.struct(F.col(at), F.col(digest))).alias("latest"))
