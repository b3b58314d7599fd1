"""Nearest neighbours by inverted lists and an adaptive scan of dimensions.

Vectors are scaled to length one, turned by a random rotation and dealt to the list of their nearest
centroid, in blocks of at most ``BLOCK`` rows, so a vector that a third of all rows hold makes more blocks,
not a larger one. A query visits the blocks of its ``probes`` nearest lists. There the rotated vectors are
scanned in column blocks of ``STEP`` dimensions: after each, a hypothesis test on the partial distance
drops candidates that are, beyond doubt ``DOUBT``, farther than the block's fifth best so far. Survivors are
ranked by their exact cosine on the original vectors in double precision.

Only the centroids and the number of lists to visit are fitted, on at most ``SAMPLE`` vectors; every valid vector is
indexed. Lists grow with the square root of the rows, as far as the sample can tell centroids apart (beyond that
a list has more blocks). The visits are the least that find ``AIM`` of the true neighbours within the sample, so
clustered vectors are searched in few lists and vectors without any structure in most. What reaches the driver
is that sample and a count per list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE = 20_000
BLOCK = 8192
QUERIES = 8192
STEP = 16
DOUBT = 2.1
#: Squared distances that differ by no more count as equal.
NOISE = 1e-9
#: Vectors of the sample for a centroid, and the share of true neighbours that the visited lists have to hold.
FOR_LIST = 64
AIM = 0.97
TRIED = 1024


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def valid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty nor zero and has finite components only."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))


def centroids(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        for j in range(k):
            own = sample[near == j]
            if len(own):
                m = own.mean(0)
                c[j] = m / (np.linalg.norm(m) or 1.0)
    return c


def visits(sample: np.ndarray, centre: np.ndarray, top: int, aim: float = AIM, seed: int = 42) -> int:
    """How many of a vector's nearest lists hold ``aim`` of its ``top`` nearest others, over ``TRIED`` vectors of the sample."""
    asked = np.random.default_rng(seed).permutation(len(sample))[:TRIED]
    home = (sample @ centre.T).argmax(1)
    needed = []
    for part in np.array_split(asked, max(1, len(asked) // 64)):
        score = sample[part] @ sample.T
        score[np.arange(len(part)), part] = -np.inf
        most = min(top, len(sample) - 1)
        if most < 1:
            return len(centre)
        near = np.argpartition(-score, most - 1, axis=1)[:, :most]
        place = np.argsort(np.argsort(-(sample[part] @ centre.T), axis=1, kind="stable"), axis=1)
        needed.append(np.take_along_axis(place, home[near], axis=1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, math.ceil(aim * len(needed)) - 1)]) + 1


def scan(q: np.ndarray, rows: np.ndarray, top: int) -> np.ndarray:
    """Row numbers of ``rows`` (rotated, unit) that the tests leave as neighbours of ``q``."""
    dim = len(q)
    kept, limit = [], math.inf
    best = np.empty(0)
    at, size = 0, 64
    while at < len(rows):
        live = np.arange(at, min(at + size, len(rows)))
        part = np.zeros(len(live))
        for low in range(0, dim, STEP):
            high = min(low + STEP, dim)
            part = part + np.square(rows[live, low:high] - q[low:high]).sum(1)
            if high < dim and limit < math.inf:
                stay = part <= limit * (high / dim) * (1 + DOUBT / math.sqrt(high)) ** 2 + NOISE
                live, part = live[stay], part[stay]
                if not len(live):
                    break
        keep = part <= limit + NOISE
        live, part = live[keep], part[keep]
        kept.append(live)
        best = np.sort(np.concatenate((best, part)))[:top]
        if len(best) == top:
            limit = best[-1]
        at, size = at + size, 1024
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def search(vectors: DataFrame, queries: DataFrame, top: int = 5, *, aim: float = AIM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest by cosine of each query, other than rows of its own vec_id.

    ``vectors`` and ``queries`` have vec_id and embedding. Rows that :func:`valid` leaves out, and rows of
    another length than the most common one, take no part. Equal scores go to the smaller vec_id. Repeated
    rows are candidates each, and queries each, with ranks of their own. Other columns are ignored; an empty table gives no rows.
    ``aim`` 1 visits every list.
    """
    spark = vectors.sparkSession
    good = valid(vectors)
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    good = good.where(F.size("v") == dim)
    sample = np.array([r[0] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()])
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    turn = rotation(dim)
    k = max(1, min(math.isqrt(n) // 2, len(sample) // FOR_LIST))
    centre = centroids(sample @ turn, k)
    probes = k if aim >= 1 else visits(sample @ turn, centre, top, aim)

    def near(many: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = np.array(b["v"].tolist())
                    u = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn
                    order = np.argsort(-(u @ centre.T), axis=1, kind="stable")[:, :many]
                    yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "lists": order.tolist()})

        return run

    shape = "vec_id long, v array<double>, lists array<int>"
    index = materialise(good.mapInPandas(near(1), shape).select("vec_id", "v", F.get("lists", 0).alias("list"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("h")), "index")
    asked = valid(queries).where(F.size("v") == dim).mapInPandas(near(probes), shape).withColumn("query", F.monotonically_increasing_id())
    asked = materialise(asked.select("query", "vec_id", "v", F.explode("lists").alias("list"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("h")), "queries")
    # A count per list, at most LISTS rows each, sets how many blocks and query groups it has.
    held = {r[0]: r[1] for r in index.groupBy("list").count().collect()}
    wanted = {r[0]: r[1] for r in asked.groupBy("list").count().collect()}
    plan = spark.createDataFrame(
        [(j, max(1, -(-2 * held[j] // BLOCK)) if held[j] > BLOCK else 1, max(1, -(-wanted[j] // QUERIES))) for j in held if j in wanted],
        "list int, blocks int, groups int",
    )
    plan = F.broadcast(plan)
    rows = index.join(plan, "list").select("list", F.pmod("h", "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "vec_id", "v")
    ask = asked.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.pmod("h", "groups").cast("int").alias("grp"), "query", "vec_id", "v")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = np.empty(0, np.int64)
        found, scores = [(none, none, none)], [np.empty(0)]
        if len(q) and len(c):
            ids, raw = c["vec_id"].to_numpy(), np.array(c["v"].tolist())
            length = np.sqrt(np.square(raw).sum(1))
            turned = (raw / length[:, None]) @ turn
            asked = np.array(q["v"].tolist())
            own = np.sqrt(np.square(asked).sum(1))
            away = (asked / own[:, None]) @ turn
            for k, (query, qid) in enumerate(zip(q["query"].tolist(), q["vec_id"].tolist(), strict=True)):
                other = np.flatnonzero(ids != qid)
                live = other[scan(away[k], turned if len(other) == len(ids) else turned[other], top)]
                score = (raw[live] * asked[k]).sum(1) / (length[live] * own[k])
                best = np.lexsort((ids[live], -score))[:top]
                found.append((np.full(len(best), query), np.full(len(best), qid), ids[live][best]))
                scores.append(score[best])
        query, qid, near = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query": query, "query_id": qid, "vec_id": near, "score": np.concatenate(scores)})

    keys = ["list", "block", "grp"]
    found = ask.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
