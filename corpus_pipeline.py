"""The corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) over all that its predecessor kept; the runner writes its
result as Parquet and reads that back as the next one's ``docs``. All but the last return the columns of
documents. A stage's scratch tables go when the next stage starts, unless that reads them, as it does before the
result between them has been written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terselake.llm import common, decontaminate, line_dedup, simhash, toxicity
from terselake.llm.queries import packed
from terselake.session import ship

SCOPE = "pipeline"
#: A document goes if its score is at least this.
TOXIC = 0.7


def _columns(doc: str, docs: DataFrame) -> list:
    return [F.col(f"{doc}.`{c}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC."""
    with common.scope(SCOPE):
        found = toxicity.score(docs, common.read(spark, sf_dir, "labels"), keep=docs.columns)
        return found.where(F.col("score") < TOXIC).select(*_columns("doc", docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that an earlier one has; n_chars follows the text."""
    with common.scope(SCOPE):
        found = line_dedup.dedup_lines(docs)
        new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
        return found.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest doc_id (null last), of several texts with it the one of least hash.

    Documents are told apart by doc_id and text, so one whose doc_id another has is judged by its own text; rows
    equal in both are copies, of which one stays.
    """
    with common.scope(SCOPE):
        rows = simhash.near_duplicates(docs).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
        rows = common.materialise(rows.select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").alias("key"), "n"), "rows")
        first = rows.groupBy("root").agg(F.min("key").alias("first"), F.count("*").alias("n"))
        judged = common.join_counted(rows.withColumnRenamed("n", "copies"), first, "root", rows.count())
        kept = F.col("key") == F.col("first")
        gone = judged.where(~kept).select(F.col("key.doc_id").alias("_d"), F.col("key.text_hash").alias("_t"))
        twice = judged.where(kept & (F.col("copies") > 1)).select(F.col("key.doc_id").alias("_d"), F.col("key.text_hash").alias("_t"))
        same = docs["doc_id"].eqNullSafe(F.col("_d")) & (simhash.text_hash(docs["text"]) == F.col("_t"))
        several = docs.join(common.small(twice), same, "left_semi").withColumn("_t", simhash.text_hash(F.col("text")))
        once = docs.join(common.small(gone.unionByName(twice)), same, "left_anti")
        return once.unionByName(several.dropDuplicates(["doc_id", "_t"]).drop("_t"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    with common.scope(SCOPE):
        found = decontaminate.contamination(docs, common.read(spark, sf_dir, "benchmark")).where(F.size("hits") > 0)
        hit = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
        same = docs["doc_id"].eqNullSafe(F.col("_d")) & (decontaminate.text_hash(docs["text"]) == F.col("_t"))
        return docs.join(common.small(hit), same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packed(docs)


def _fresh(stage: Callable) -> Callable:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, SCOPE, unless=docs)
        return stage(ship(spark), docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _fresh(drop_toxic)),
    ("line_dedup", _fresh(dedup_lines)),
    ("near_duplicates", _fresh(drop_near_duplicates)),
    ("decontamination", _fresh(drop_contaminated)),
    ("packing", _fresh(pack)),
]

#: The language model, fingerprint majority and tokenizer have no SQL form; tests hold the operators and stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, name)
    return docs
