"""Log chunking as gaps and islands: windows over exploded lines, no Python.

A line starts a record if it looks like the start of one; the first line that isn't blank does; others
extend the record if they look like a continuation or lie in a stack trace, which lasts from its opening
line to the next record start. Without any record start, every line is a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import NAMES

_BLANK = r"(?U)^\s*$"


def log_lines(docs: DataFrame) -> DataFrame:
    """doc_id, name, no (from 0), line, at (its first character)."""
    lines = docs.select("doc_id", "name", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    before = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("at", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int"))


def log_records(docs: DataFrame) -> DataFrame:
    """Chunks of kind ``log_record`` with template, level and line count from ``docs`` (doc_id, name, text)."""
    doc = Window.partitionBy("doc_id")
    upto = doc.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    before = doc.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("line").rlike(T.LOG_START)
    opens = F.col("line").rlike(T.LOG_TRACE)
    blank = F.col("line").rlike(_BLANK)
    marked = log_lines(docs).select(
        "*",
        start.alias("start"),
        blank.alias("blank"),
        F.when(start, F.lit(False)).when(opens, F.lit(True)).alias("trace"),
        F.max(start).over(doc).alias("any_start"),
    )
    in_trace = F.coalesce(F.last("trace", ignorenulls=True).over(before), F.lit(False))
    seen = F.coalesce(F.max(~F.col("blank")).over(before), F.lit(False))
    extends = seen & (F.col("blank") | in_trace | F.col("line").rlike(T.LOG_CONTINUES))
    first = ~F.col("blank") & F.when(F.col("any_start"), F.col("start") | ~extends).otherwise(True)
    records = (
        marked.withColumn("first", first)
        .withColumn("record", F.sum(F.col("first").cast("int")).over(upto))
        .where("record > 0")
        .groupBy("doc_id", "name", "record")
        .agg(
            F.sort_array(F.collect_list(F.struct("no", "line"))).alias("all"),
            F.min("no").alias("no"),
            F.min("at").alias("start_char"),
        )
    )
    text = F.array_join(F.transform("all", lambda x: x["line"]), "\n")
    body = F.regexp_replace(text, r"(?U)\s+$", "")
    return chunk_rows(
        records.select(
            "doc_id",
            F.col("name").alias("source"),
            F.lit("log_record").alias("kind"),
            body.alias("text"),
            "start_char",
            (F.col("no") + 1).cast("int").alias("start_line"),
            T.log_template(body).alias("template"),
            T.log_level(body).alias("level"),
            F.substring(T.log_template(body), 1, 120).alias("symbol"),
            (1 + F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).alias("lines"),
        )
    )


def chunk_rows(spans: DataFrame) -> DataFrame:
    """Fills the columns of a chunk that follow from its text and place; missing ones are null.

    Spans that come with their number need no window, and so no exchange.
    """
    newlines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    out = spans
    if "end_char" not in out.columns:
        out = out.withColumn("end_char", (F.col("start_char") + F.length("text")).cast("int"))
    if "ord" not in out.columns:
        order = Window.partitionBy("doc_id").orderBy("start_char", "end_char")
        out = out.withColumn("ord", (F.row_number().over(order) - 1).cast("int"))
    if "token_count" not in out.columns:
        out = out.withColumn("token_count", T.token_count("text"))
    if "end_line" not in out.columns:
        out = out.withColumn("end_line", (F.col("start_line") + newlines).cast("int"))
    for c, t in (
        ("symbol", "string"), ("template", "string"), ("level", "string"), ("lines", "int"), ("section", "string"),
        ("heading_level", "int"), ("language", "string"), ("merged_parts", "int"), ("split_part", "int"), ("split_of", "int"),
        ("forward_anchor", "boolean"), ("fallback", "boolean"),
    ):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    safe = F.regexp_replace(F.col("source"), r"[^A-Za-z0-9_.\-/]+", "_")
    name = F.when(F.coalesce(safe, F.lit("")) == "", "input").otherwise(safe)
    suffix = F.when(F.coalesce(F.col("symbol"), F.lit("")) != "", F.concat(F.lit(":"), "symbol")).otherwise("")
    out = out.withColumn("id", F.concat(name, F.lit("#"), F.format_string("%04d", "ord"), F.lit(":"), "kind", suffix))
    return out.select(*NAMES)
