"""The guard on streams: detection and masking keep no state; restoring joins the table of tokens that the caller keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.guard import Guard, restore


def mask_stream(stream: DataFrame, guard: Guard, row_key: str, text_col: str = "text") -> DataFrame:
    """Append mode; the same columns as in batch."""
    return guard.mask(stream, row_key, text_col)


def restore_stream(stream: DataFrame, tokens: DataFrame, key: str, response_col: str) -> DataFrame:
    """Responses joined with a static table of key and tokens. A response without an entry gets the status of a missing token set."""
    return restore(stream.join(tokens.select(key, "tokens"), key, "left"), response_col, "tokens")


def windowed_findings(found: DataFrame, ts_col: str = "ts", width: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Findings (entity, timestamp) counted by window and entity; on a stream, late rows are waited for as long as the watermark says."""
    rows = found.withWatermark(ts_col, late) if late and found.isStreaming else found
    counts = rows.groupBy(F.window(ts_col, width).alias("w"), "entity").agg(F.count(F.lit(1)).alias("findings"))
    return counts.select(F.col("w.start").alias("window_start"), "entity", "findings")
