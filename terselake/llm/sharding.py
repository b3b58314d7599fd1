"""Sharding by a two-pass external shuffle.

Pass one writes every record once, with a seeded hash that is uniform over records (not over keys, so
a hot key scatters too), and no exchange. Pass two deals the hash into buckets of a bounded number of
bytes and rows, draws a Fisher-Yates permutation for every bucket (Spark's ``shuffle`` of an index array)
and gives each record its place in the order of all buckets. Cutting that order into equal ranges gives
shards whose counts differ by one at most.

Only the byte and row totals and the largest bucket's row count reach the driver. Bucket offsets are a
two-level prefix sum, so the one task that sees every group handles a row per ``GROUP`` buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

GROUP = 4096


def external_shuffle(
    records: DataFrame,
    shards: int,
    size: Column,
    *,
    seed: int = 42,
    bucket_bytes: int = 4 << 20,
    bucket_rows: int = 1 << 16,
    task_bytes: int = 128 << 20,
) -> DataFrame:
    """Returns ``record`` (a struct of all input columns), ``shard`` int and ``slot`` long.

    ``size`` is a record's bytes; null counts 0. Nulls, repeated rows and ties are records like any
    other; column names can't clash, as the record stays a struct. An empty table gives no rows. The
    scattered table is written before anything depends on it, so a lost executor can't move a record.
    """
    spark = records.sparkSession
    scattered = materialise(
        records.select(
            F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"),
            F.coalesce(size, F.lit(0)).cast("long").alias("bytes"),
            F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("h"),
        ),
        "scattered",
    )
    total = scattered.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    n = total["n"]
    buckets = max(1, -(-(total["bytes"] or 0) // bucket_bytes), -(-n // bucket_rows))
    # A task takes some buckets, and there are as many tasks as their bytes ask for.
    tasks = max(min(buckets, spark.sparkContext.defaultParallelism), -(-(total["bytes"] or 0) // task_bytes))
    scattered = scattered.select("record", "h", F.pmod("h", F.lit(buckets)).alias("bucket"))
    counts = materialise(scattered.groupBy("bucket").agg(F.count("*").alias("rows")), "buckets")
    largest = counts.agg(F.max("rows")).first()[0] or 1

    group = F.expr(f"bucket div {GROUP}")
    groups = counts.groupBy(group.alias("grp")).agg(F.sum("rows").alias("rows"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("grp", F.coalesce(F.sum("rows").over(before.orderBy("grp")), F.lit(0)).alias("base"))
    within = F.sum("rows").over(before.partitionBy("grp").orderBy("bucket"))
    offsets = (
        counts.withColumn("grp", group)
        .withColumn("within", F.coalesce(within, F.lit(0)))
        .join(groups, "grp")
        .select("bucket", "rows", (F.col("base") + F.col("within")).alias("offset"))
    )
    # A permutation of 0..largest-1, cut to the bucket's own row numbers, is a uniform permutation of those.
    # The range's partitions and order are fixed, so a recomputed task draws the same permutations.
    drawn = spark.range(0, buckets, 1, max(1, min(buckets, -(-buckets * largest // (1 << 20))))).select(
        F.col("id").alias("bucket"), F.shuffle(F.sequence(F.lit(0), F.lit(int(largest) - 1)), seed).alias("drawn")
    )
    plan = offsets.join(drawn, "bucket").select(
        "bucket", "offset", F.filter("drawn", lambda i: i < F.col("rows")).alias("order")
    )
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("h"))
    placed = scattered.repartition(tasks, "bucket").withColumn("at", at).join(plan, "bucket")
    place = placed.select("record", (F.col("offset") + F.element_at("order", F.col("at"))).alias("place"))
    shard = place.withColumn("shard", F.expr(f"(place * {shards}L) div {max(n, 1)}L"))
    return shard.select(
        "record",
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")).alias("slot"),
    )


def write_shards(placed: DataFrame, path: str, *, rows_per_file: int = 1 << 20) -> None:
    """Writes the records as ``shard=N`` folders, each file a run of slots in order."""
    part = F.expr(f"slot div {rows_per_file}")
    placed.repartition(F.col("shard"), part).sortWithinPartitions("shard", "slot").select(
        "record.*", "slot", "shard"
    ).write.partitionBy("shard").parquet(path)
