"""Near-duplicate groups by SimHash, with meet-in-the-middle ball hashing.

Fingerprints at ``3`` or fewer differing bits are linked. Half that radius, rounded down, is 1: two
fingerprints at distance 2 or less share a variant at distance 1. For the odd third bit, each fingerprint
emits its ball three times, each time with another third of the bits blanked: among any three differing
bits at least one lies in some third, and with that third blanked at most two differ. So each of the
distinct fingerprints emits about 131 variants, all links are found, and a random collision needs 42
equal bits. Variants are shuffled, equal ones meet in sorted order, and their fingerprints are compared
in full. A meeting place hands on a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, materialise, small

RADIUS = 3
PARTS = ((0, 22), (22, 43), (43, 64))
SHINGLE = 3
SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit majority over the XXH64 of all 3-word shingles, as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return int(np.array([h64(joined, SEED)], np.uint64).view(np.int64)[0])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        a, b = starts[at : min(at + CHUNK, n)].tolist(), ends[at + SHINGLE - 1 : at + SHINGLE - 1 + CHUNK].tolist()
        h = np.array([h64(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), text_hash(F.col("text")).alias("h"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.octet_length(text))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ball() -> list[tuple[int, int]]:
    """(bits kept, bits flipped and tag) of every variant; the tag sits in the blanked part."""
    full, out = (1 << 64) - 1, []
    for tag, (low, high) in enumerate(PARTS):
        keep = full ^ (((1 << high) - 1) ^ ((1 << low) - 1))
        for flip in [0] + [1 << i for i in range(64) if not low <= i < high]:
            out.append((_signed(keep), _signed(flip | tag << low)))
    return out


def spanning(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among ``fps``: each one is compared only with those not yet reached."""
    a, b, rest = [], [], fps
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= RADIUS
            found = rest[near]
            a += [int(x)] * len(found)
            b += found.tolist()
            todo += list(found)
            rest = rest[~near]
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def runs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        size = ends - starts
        two = starts[size == 2]
        x, y = fp[two], fp[two + 1]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS
        a, b = [x[near]], [y[near]]
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            p, q = spanning(fp[s:e])
            a.append(np.array(p, np.int64))
            b.append(np.array(q, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate((key, batch.column(0).to_numpy()))
        fp = np.concatenate((fp, batch.column(1).to_numpy()))
        last = int(np.searchsorted(key, key[-1]))  # the last key's run may go on
        if last:
            yield runs(key[:last], fp[:last])
            key, fp = key[last:].copy(), fp[last:].copy()
    if len(key):
        yield runs(key, fp)


def links(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp long, distinct) to links (a, b) whose components are those of all pairs within the radius."""
    masks = F.expr("array(" + ",".join(f"struct({k}L as k, {f}L as f)" for k, f in ball()).replace("-9223372036854775808L", "(-9223372036854775807L - 1L)") + ")")
    variants = nodes.select("fp", F.explode(masks).alias("m")).select(
        F.col("fp").bitwiseAND(F.col("m.k")).bitwiseXOR(F.col("m.f")).alias("key"), "fp"
    )
    return variants.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Returns doc_id, text_hash, fp (signed long), root and component_id, a row per row of ``docs`` (doc_id, text).

    Component: the smallest non-null doc_id reachable by links, null if there is none; ``root`` is the smallest
    fingerprint reachable and names the component also where doc_ids clash. A null or empty text has fingerprint
    zero and is linked like any other; repeated rows come back repeated; other columns are ignored; an empty table
    gives no rows. Copies share a fingerprint and are one node.
    """
    fps = materialise(fingerprints(docs), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    groups = materialise(components(materialise(links(nodes.select("fp")), "links")), "components")
    named = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    sizes = named.groupBy("root").agg(F.count("*").alias("members"), F.min("least").alias("component_id"))
    many = materialise(sizes.where("members > 1").withColumnRenamed("members", "n"), "many")
    rest = named.select("fp", "root", F.col("n").alias("rows"), "least")
    alone = rest.join(small(many.select("root")), "root", "left_anti").select("fp", "root", "rows", F.col("least").alias("component_id"))
    linked = join_counted(rest.drop("least"), many, "root", nodes.count()).select("fp", "root", "rows", "component_id")
    whole = materialise(alone.unionByName(linked).withColumnRenamed("rows", "n"), "whole")
    return join_counted(fps, whole, "fp", fps.count()).select("doc_id", "text_hash", "fp", "root", "component_id")
