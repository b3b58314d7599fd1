"""Streaming forms of the log operators: templates deduplicated within a watermark, and counts in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def templated(lines: DataFrame, text: str = "line") -> DataFrame:
    return lines.withColumns({"template": T.log_template(text), "level": T.log_level(text)})


def first_of_template(lines: DataFrame, delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """The first line of each template while it keeps coming; state goes with the watermark."""
    return templated(lines).withWatermark(time, delay).dropDuplicatesWithinWatermark(["template"])


def template_counts(lines: DataFrame, window: str = "5 minutes", delay: str = "10 minutes", time: str = "ts", slide: str | None = None) -> DataFrame:
    """Records per template and level in tumbling or sliding windows; late lines beyond the delay are left out."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return templated(lines).withWatermark(time, delay).groupBy(span, "template", "level").agg(F.count("*").alias("n"))


def incident_sessions(lines: DataFrame, gap: str = "2 minutes", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Runs of error records no further apart than ``gap``."""
    errors = templated(lines).where(F.col("level").isin("ERROR", "FATAL", "CRITICAL", "SEVERE")).withWatermark(time, delay)
    return errors.groupBy(F.session_window(time, gap)).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
