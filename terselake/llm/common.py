"""Helpers shared by the corpus operators: scopes of scratch tables, size-checked broadcasts and components."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, materialise, path, written

__all__ = ["components", "join_counted", "let", "lower_ascii", "materialise", "path", "read", "release", "scope", "small"]

#: The largest table that an operator hands to every executor; a larger one is joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: A key that more rows share is joined by broadcast.
HOT_ROWS = 100

_scopes: dict[str, list[str]] = defaultdict(list)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Scratch tables written inside belong to ``name``, so that :func:`release` can remove just those."""
    with written() as paths:
        yield
    _scopes[name] += paths


def release(spark: SparkSession, name: str, unless: DataFrame | None = None) -> None:
    """Removes the scratch tables of a scope, once what reads them has been written; those that ``unless`` reads stay."""
    used = unless.inputFiles() if unless is not None and _scopes[name] else []
    kept = [p for p in _scopes[name] if any(p.rsplit("/", 1)[1] in f for f in used)]
    drop(spark, [] if kept else _scopes[name])


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if it has at most ``rows`` rows, else leaves it to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_counted(rows: DataFrame, counted: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``counted`` (key, n, ...), which has a row per key and how many of ``rows`` hold it.

    Keys of more than ``HOT_ROWS`` rows, or a millionth of the ``total``, are joined by broadcast: fewer than
    1,000,000 at any size. So a hot key's rows stay spread as they are, and the shuffle sees only the others.
    """
    limit = max(HOT_ROWS, total // 1_000_000)
    hot = F.broadcast(counted.where(F.col("n") > limit).drop("n"))
    rest = counted.where(F.col("n") <= limit).drop("n")
    cold = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(rest, key))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, so that lambdas inside don't evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, other letters as they are; pure ASCII text takes the fast way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a long, b long): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps. Edges live in scratch tables, and only a count and a
    checksum of the edges reach the driver. A star's centre has many edges: they are joined by broadcast.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now["n"] == 0 or (now["n"], now["x"]) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        before = (now["n"], now["x"])
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.count("*").alias("n"), F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_counted(both, low, "u", 2 * now["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "stars")
        low = large.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
        near = join_counted(large, low, "u", 2 * now["n"])
        small_star = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            near.select("u", F.col("m").alias("v"))
        )
        edges = materialise(small_star.where("u <> v").distinct(), "edges")
