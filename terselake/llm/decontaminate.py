"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``SPAN`` consecutive words. Of its ``SPAN - GRAM + 1`` word grams the one with the least hash
is its fingerprint, so every window that a document shares with the benchmark shares its fingerprint too:
nothing is missed. A document's windows whose fingerprint is in the benchmark's set are extended to all
their words and joined with the benchmark's windows on fingerprint and words, which makes the result exact.

The word array zipped with itself, shifted by 1 to ``SPAN - 1``, gives a row per position with its window
in columns, so hashing and selection run in generated code, without a shuffle. The fingerprint join is a
broadcast while the benchmark has at most ``BROADCAST_ROWS`` fingerprints and a shuffle beyond that; only
windows that meet one go on. Items shorter than a window are one window as they are: their own lengths are
tried at every position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small

SPAN = 10
GRAM = 5
#: Characters that stand between words, after A-Z are lower-cased.
BETWEEN = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Longer than any array, and no overflow when a start is added.
ENDLESS = 2**30


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + BETWEEN, UPPER.lower() + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def _shifted(tokens: Column) -> Column:
    return F.arrays_zip(*[(F.slice(tokens, k + 1, ENDLESS) if k else tokens).alias(f"w{k}") for k in range(SPAN)])


def _word(k: int) -> Column:
    return F.col(f"p.w{k}")


def _fingerprint(n: int) -> Column:
    """Of the window of ``n`` words at a position; means nothing where fewer remain."""
    hashes = [F.xxhash64(_word(k)) for k in range(n)]
    if n < SPAN:
        return F.xxhash64(*hashes, F.lit(n))
    return F.least(*[F.xxhash64(*hashes[k : k + GRAM]) for k in range(SPAN - GRAM + 1)])


def _phrase(n: int) -> Column:
    return F.concat_ws(" ", *[_word(k) for k in range(n)])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(len, h, phrase, items): each distinct window, its fingerprint, and the ids of the items that have it."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w"))
    at = items.select("item_id", F.size("w").alias("n"), F.posexplode(_shifted(F.col("w"))).alias("k", "p"))
    options = []
    for n in range(1, SPAN + 1):
        fits = (F.col("n") == n) & (F.col("k") == 0) if n < SPAN else _word(SPAN - 1).isNotNull()
        options.append((fits, F.struct(F.lit(n).alias("len"), _fingerprint(n).alias("h"), _phrase(n).alias("phrase"))))
    window = F.coalesce(*[F.when(fits, w) for fits, w in options])
    found = at.select("item_id", window.alias("w")).where("w is not null")
    return found.groupBy("w.len", "w.h", "w.phrase").agg(F.collect_set("item_id").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, text_hash, n_words, hits, items.

    ``hits`` are the 0-based positions of document words inside a window of the benchmark, sorted;
    ``items`` the ids of items with such a window. A null text has no words; an item without words has no
    window; null item_ids are left out of ``items``. Rows equal in doc_id and text are told apart by
    number only, and each comes back. Columns other than those named are ignored. Empty tables: no
    documents give no rows, no benchmark leaves every document clean.
    """
    windows = materialise(benchmark_windows(benchmark), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect()) or [SPAN]
    prints = small(windows.select("len", "h").distinct().withColumn("known", F.lit(True)))

    read = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), words(F.col("text")).alias("w"))
    at = read.select(
        "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(_shifted(F.col("w"))).alias("k", "p")
    )
    first = F.coalesce("k", F.lit(0)) == 0
    if lengths == [SPAN]:
        at = at.select("*", F.lit(SPAN).alias("len"), _fingerprint(SPAN).alias("h"), first.alias("first"))
    else:
        options = F.array(*[F.struct(F.lit(n).alias("len"), _fingerprint(n).alias("h")) for n in lengths])
        at = at.select("*", F.posexplode(options).alias("e", "o")).select(
            "*", "o.len", "o.h", (first & (F.col("e") == 0)).alias("first")
        )
    whole = F.coalesce(*[F.when((F.col("len") == n) & _word(n - 1).isNotNull(), _phrase(n)) for n in lengths])
    tried = at.join(prints, ["len", "h"], "left").where(F.col("first") | F.col("known")).select(
        "doc_id",
        "text_hash",
        "n_words",
        F.col("first").cast("int").alias("first"),
        F.col("k").alias("at"),
        "len",
        F.when(F.col("known"), F.col("h")).otherwise(F.xxhash64("doc_id", "text_hash")).alias("h"),  # the others spread out
        F.when(F.col("known"), whole).alias("phrase"),
    )
    tried = tried.withColumn("phrase", F.coalesce("phrase", F.lit("")))
    met = tried.join(small(windows), ["len", "h", "phrase"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("at", "len"))
    found = met.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum("first").cast("int").alias("copies"), F.collect_set(hit).alias("at"), F.collect_set("items").alias("items")
    )
    reach = F.transform("at", lambda w: F.sequence(w["at"], w["at"] + w["len"] - 1))
    return found.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.array_sort(F.array_distinct(F.flatten(reach))).alias("hits"),
        F.array_distinct(F.flatten("items")).alias("items"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))
