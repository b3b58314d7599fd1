"""Routing of documents to a chunker, and checks on what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .logs import log_records
from .prose import PYTHON, SCRIPT, SIZES, Chunking, prose_chunks


def detect_kind(name: Column | str = "name", text: Column | str = "text") -> Column:
    """code by the name's suffix, else log by the text's lines, else text."""
    low = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    code = F.lit(False)
    for suffix in (*PYTHON, *SCRIPT):
        code = code | low.endswith(suffix)
    return F.when(code, "code").when(F.coalesce(T.looks_like_log(text), F.lit(False)), "log").otherwise("text")


def chunk(docs: DataFrame, kind: str | None = None, sizes: Chunking = SIZES) -> DataFrame:
    """Chunks of ``docs`` (doc_id, name, text); ``kind`` forces one of log, text or code for all."""
    if kind not in (None, "log", "text", "code"):
        raise ValueError(f"no such chunker: {kind}")
    base = docs.select("doc_id", "name", "text").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"(?U)^\s*$"))
    if kind == "log":
        return log_records(base)
    if kind:
        return prose_chunks(base, kind, sizes)
    routed = base.withColumn("route", detect_kind())
    return log_records(routed.where("route = 'log'").drop("route")).unionByName(prose_chunks(routed.where("route <> 'log'").drop("route"), sizes=sizes))


def tiling_problems(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, id, problem: chunks that overlap, leave text between them, or differ from their document.

    A document meets its chunks as one list, so its text is neither copied nor shuffled per chunk.
    """
    listed = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "start_char", "end_char", "text"))).alias("all"))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    whole, n = F.col("whole"), F.size("all")

    def judge(c: Column, i: Column) -> Column:
        before = F.when(i == 0, 0).otherwise(F.get("all", i - 1)["end_char"])
        problem = (
            F.when(c["start_char"] < before, "overlap")
            .when(bare(F.substring(whole, before + 1, c["start_char"] - before)) != "", "gap")
            .when(F.substring(whole, c["start_char"] + 1, c["end_char"] - c["start_char"]) != c["text"], "drift")
            .when((i == n - 1) & (bare(F.substring(whole, c["end_char"] + 1, F.length(whole))) != ""), "tail")
        )
        return F.struct(c["id"].alias("id"), problem.alias("problem"))

    both = docs.select("doc_id", F.col("text").alias("whole")).join(listed, "doc_id")
    return both.select("doc_id", F.inline(F.transform("all", judge))).where("problem is not null")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document and kind: count, least, upper median, largest and total tokens."""
    tokens = F.sort_array(F.collect_list("token_count"))
    return chunks.groupBy("doc_id", "kind").agg(
        F.count("*").alias("n"),
        F.min("token_count").alias("least"),
        F.get(tokens, F.floor(F.size(tokens) / 2).cast("int")).alias("p50"),
        F.max("token_count").alias("most"),
        F.sum("token_count").alias("total"),
    )
