"""Vectors for chunks: a pluggable embedder, a deterministic one that needs no model, and vector columns."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SETTLED

Embedder = Callable[[list[str]], np.ndarray]
#: Texts that each provider takes at once.
BATCH = {"openai": 256, "gemini": 100, "cohere": 96, "local": 256}
RETRY_PAUSE = 0.4
COOLDOWN = 60.0


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def hashing_embedder(dim: int = 256) -> Embedder:
    """Signed hashed words and word pairs. Not calibrated: use the default threshold and say so."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            words = (text or "").lower().split()
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        return unit(out)

    return embed


def embed(df: DataFrame, embedder: Embedder | Chain, text: str = "text", batch: int = 256) -> DataFrame:
    """Adds ``vector`` (unit, array of float); one call per batch, one retry where that may help.

    Of a chain, the first provider that answers a probe on the driver embeds the whole table, in batches of the size
    that it takes, as vectors of different providers can't be compared.
    """
    if isinstance(embedder, Chain):
        name, _ = embedder.run([""])
        embedder, batch = next(f for n, _, f in embedder.providers if n == name), BATCH.get(name, batch)

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            out = [call(embedder, texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series(list(np.concatenate(out).astype(np.float32)) if out else [], dtype=object)

    return df.withColumn("vector", vectors(F.col(text)))


def retryable(reason: str) -> bool:
    return not any(m in reason.lower() for m in SETTLED)


def call(embedder: Embedder, texts: list[str], pause: float = RETRY_PAUSE) -> np.ndarray:
    for attempt in (0, 1):
        try:
            v = np.asarray(embedder(texts), np.float64)
            break
        except Exception as e:
            if attempt or not retryable(str(e)):
                raise
            time.sleep(pause)
    if len(v) != len(texts):
        raise ValueError(f"{len(texts)} texts gave {len(v)} vectors")
    return unit(v)


@dataclass
class Attempt:
    provider: str
    outcome: str  # ok, failed, timeout, cooling or unconfigured
    reason: str = ""


@dataclass
class Chain:
    """Providers in order of preference: (name, configured, call). A failure other than a timeout cools one down."""

    providers: list[tuple[str, bool, Callable]]
    cooldown: float = COOLDOWN
    clock: Callable[[], float] = time.monotonic
    attempts: list[Attempt] = field(default_factory=list)
    _until: dict[str, float] = field(default_factory=dict)

    @property
    def available(self) -> bool:
        return any(ok and self._until.get(n, 0) <= self.clock() for n, ok, _ in self.providers)

    def run(self, *args):
        """(provider, result) of the first that succeeds; RuntimeError naming all if none does."""
        failed = []
        for name, configured, f in self.providers:
            if not configured:
                self.attempts.append(Attempt(name, "unconfigured"))
            elif self._until.get(name, 0) > self.clock():
                self.attempts.append(Attempt(name, "cooling"))
            else:
                try:
                    out = f(*args)
                except TimeoutError as e:
                    self.attempts.append(Attempt(name, "timeout", str(e)))
                except Exception as e:
                    self.attempts.append(Attempt(name, "failed", str(e)))
                    self._until[name] = self.clock() + self.cooldown
                else:
                    self.attempts.append(Attempt(name, "ok"))
                    return name, out
            failed.append(f"{name}: {self.attempts[-1].outcome} {self.attempts[-1].reason}".strip())
        raise RuntimeError("no provider answered: " + "; ".join(failed))

    def try_run(self, *args):
        try:
            return self.run(*args)
        except RuntimeError:
            return None


LOCAL = ("local",)


def choose(providers: list[str], mode: str = "auto", pin: str | None = None, offline: bool = False) -> list[str]:
    """Names to try. Cloud never falls back to local; a pin has no fallback; offline leaves only local ones."""
    if mode not in ("auto", "local", "cloud"):
        raise ValueError(f"no such mode: {mode}")
    if pin is not None:
        if pin not in providers:
            raise ValueError(f"no such provider: {pin}")
        if offline and pin not in LOCAL:
            raise ValueError(f"{pin} needs a network")
        return [pin]
    keep = lambda n: (n in LOCAL) if mode == "local" or offline else (n not in LOCAL) if mode == "cloud" else True
    return [n for n in providers if keep(n)]


def catalogue(spark, embedding: list[tuple[str, bool]], generation: list[tuple[str, bool]], preference=("cohere", "gemini", "openai", "local")) -> DataFrame:
    """Presets: each generator with the embedder to use beside it, its own vendor's if ready, else the first ready by
    preference; ``why`` says what a preset that isn't ready lacks."""
    rank = {n: i for i, n in enumerate(preference)}
    e = spark.createDataFrame([(n, ok, rank.get(n, len(rank))) for n, ok in embedding], "embedder string, embedder_ready boolean, rank int")
    g = spark.createDataFrame(generation, "generator string, ready boolean")
    own = g.join(F.broadcast(e.where("embedder_ready")), F.col("generator") == F.col("embedder"), "left")
    best = e.where("embedder_ready").agg(F.min_by("embedder", "rank").alias("best"))
    why = F.when(~F.col("ready"), "no generator").when(F.coalesce("embedder", "best").isNull(), "no embedder")
    return own.join(F.broadcast(best)).select("generator", "ready", F.coalesce("embedder", "best").alias("embedder"), F.col("generator").isin(*LOCAL).alias("local"), why.alias("why"))


def readiness(presets: DataFrame) -> DataFrame:
    """(mode, ready, generators, embedders): whether a generator of each mode can be used; embeddings may be missing."""
    mode = F.when(F.col("local"), "local").otherwise("cloud")
    names = lambda c: F.sort_array(F.collect_set(c))
    return presets.groupBy(mode.alias("mode")).agg(
        F.bool_or("ready").alias("ready"), names(F.when(F.col("ready"), F.col("generator"))).alias("generators"), names("embedder").alias("embedders")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def centroid(rows: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """(group, centroid): the mean vector, by dimension, summed before the shuffle."""
    parts = rows.select(group, F.posexplode(vector).alias("k", "x"))
    mean = parts.groupBy(group, "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("centroid"))
