"""Thin queries over the corpus operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, decontaminate, html_main, line_dedup, packing, sharding, simhash, toxicity, url_graph, warc
from .common import path, read

Query = Callable[[SparkSession, str], DataFrame]


def packed(docs: DataFrame) -> DataFrame:
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost"
    )


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(ship(spark), sf_dir, "documents"))


def op2_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(read(spark, sf_dir, "pages"))


def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(ship(spark), sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(read(ship(spark), sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc.doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_main.extract(read(ship(spark), sf_dir, "pages"))
    return found.select("page.page_id", "page.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(read(ship(spark), sf_dir, "pages"), path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(ship(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return sharding.external_shuffle(docs, 16, size).select(
        "record.doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc.doc_id", "text", "runs_removed", "words_removed")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pack,
        op2_link_graph,
        op3_adaptive_scan,
        op4_kneser_ney,
        op5_line_blocks,
        op6_arc_to_warc,
        op7_simhash,
        op8_decontaminate,
        op9_shard,
        op10_line_dedup,
    )
}
ORACLES: dict[str, str] = {}
