"""Redundancy within a document: exact and template keys, code shape, then similarity.

Passes run cheapest first and each sees the survivors of the one before. Keys are grouped by windows over
(doc_id, key); only the similarity pass, in which each chunk's fate depends on the leaders before it,
runs per document in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import PROTECTED_KINDS, STRUCTURAL_KINDS

# ---- fixed values: the lexer of code, and words it keeps ----
LEXER = (
    r"(?s)((?:#[^\n]*|//[^\n]*|/\*.*?\*/))"
    "|([rRbBuUfF]{0,2}(?:\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\\\.|[^\"\\\\\\n])*\"|'(?:\\\\.|[^'\\\\\\n])*'|`(?:\\\\.|[^`\\\\])*`))"
    r"|(0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)"
    r"|([A-Za-z_$][A-Za-z0-9_$]*)|(\S)"
)
KEYWORDS = (
    "and as assert async await break case catch class const continue def default del delete do elif else except export extends "
    "finally for from function global if import in instanceof is lambda let new nonlocal not of or pass raise return static super "
    "switch this throw try typeof var void while with yield null undefined true false None True False"
).split()
MIN_SHAPE_TOKENS = 30
THRESHOLD = 0.88
THRESHOLDS = {"local": 0.88, "cohere": 0.84}
# ---- end of fixed values ----


def dedup_key() -> Column:
    """A template's records are equal; other chunks are if their text is, white space aside."""
    return F.coalesce(F.concat(F.lit("tpl:"), "template"), F.concat(F.lit("txt:"), F.md5(T.squeeze("text").cast("binary"))))


def shape(text: Column | str) -> Column:
    """The code's tokens with comments gone and strings and names blanked; numbers and keywords stay."""
    tokens = F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(LEXER), F.lit(0))
    comment = lambda t: t.startswith("#") | t.startswith("//") | t.startswith("/*")
    quoted = lambda t: t.rlike("^[rRbBuUfF]{0,2}[\"'`]") & (F.length(t) > 1)
    return F.transform(
        F.filter(tokens, lambda t: ~comment(t)),
        lambda t: F.when(quoted(t), "<STR>")
        .when(t.rlike(r"^\d"), F.replace(t, F.lit("_"), F.lit("")))
        .when(t.rlike("^[A-Za-z_$]") & ~t.isin(*KEYWORDS), "<ID>")
        .otherwise(t),
    )


def structural_signature() -> Column:
    tokens = shape("text")
    return F.when(F.size(tokens) > 0, F.concat(F.lit("str:"), "kind", F.lit(":"), F.md5(F.array_join(tokens, " ").cast("binary"))))


def _by_key(chunks: DataFrame, key: Column, eligible: Column, method: str) -> DataFrame:
    """Sets ``leader`` and ``method`` of eligible, not yet absorbed chunks whose key an earlier one has."""
    live = chunks.withColumn("_key", F.when(eligible & F.col("leader").isNull(), key))
    first = F.first("id").over(Window.partitionBy("doc_id", "_key").orderBy("ord"))
    absorbed = F.col("_key").isNotNull() & (first != F.col("id"))
    marked = live.withColumn("_first", F.when(absorbed, first))
    return marked.select(
        *[c for c in chunks.columns if c not in ("leader", "method", "similarity")],
        F.coalesce("leader", "_first").alias("leader"),
        F.coalesce("method", F.when(F.col("_first").isNotNull(), F.lit(method))).alias("method"),
        F.coalesce("similarity", F.when(F.col("_first").isNotNull(), F.lit(1.0))).alias("similarity"),
    )


def unmarked(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns(
        {"leader": F.lit(None).cast("string"), "method": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")}
    )


def label() -> Column:
    """What stands for an absorbed chunk in its cluster."""
    return F.coalesce(F.substring("symbol", 1, 80), T.preview("text", 60))


def keyed(chunks: DataFrame) -> DataFrame:
    """Adds what deduplication reads of a chunk's text, so that the passes and :func:`clusters` go without the text."""
    signature = F.when(F.col("kind").isin(*STRUCTURAL_KINDS), structural_signature())
    flat = F.col("_flat")
    preview = F.when(F.length(flat) <= 60, flat).otherwise(F.concat(F.substring(flat, 1, 59), F.lit("…")))
    key = F.coalesce(F.concat(F.lit("tpl:"), "template"), F.concat(F.lit("txt:"), F.md5(flat.cast("binary"))))
    found = {"dedup_key": key, "signature": signature, "label": F.coalesce(F.substring("symbol", 1, 80), preview)}
    return chunks.withColumn("_flat", T.squeeze("text")).withColumns(found).drop("_flat")


def _known(chunks: DataFrame, name: str, value: Callable[[], Column]) -> Column:
    return F.col(name) if name in chunks.columns else value()


def exact_pass(chunks: DataFrame) -> DataFrame:
    return _by_key(chunks, _known(chunks, "dedup_key", dedup_key), ~F.col("kind").isin(*PROTECTED_KINDS), "exact")


def structural_pass(chunks: DataFrame, min_tokens: int = MIN_SHAPE_TOKENS) -> DataFrame:
    fits = F.col("kind").isin(*STRUCTURAL_KINDS) & (F.col("token_count") >= min_tokens)
    return _by_key(chunks, _known(chunks, "signature", structural_signature), fits, "structural")


def threshold(provider: str | None, table: dict[str, float] | None = None, default: float = THRESHOLD) -> tuple[float, str | None]:
    """The similarity threshold, and a note where it wasn't calibrated for the provider."""
    known = THRESHOLDS if table is None else table
    if provider in known:
        return known[provider], None
    return default, f"threshold {default} is not calibrated for {provider or 'this embedder'}"


def follow(vectors: np.ndarray, least: float) -> tuple[list[int], list[float]]:
    """For unit rows in order: each one's leader (itself if it leads) and the cosine to it."""
    leaders: list[int] = []
    to, score = [], []
    matrix = np.empty_like(vectors)
    for i, v in enumerate(vectors):
        if leaders:
            s = matrix[: len(leaders)] @ v
            k = int(s.argmax())
            if s[k] >= least:
                to.append(leaders[k])
                score.append(float(s[k]))
                continue
        matrix[len(leaders)] = v
        leaders.append(i)
        to.append(i)
        score.append(1.0)
    return to, score


def leader_clusters(rows: DataFrame, least: float, group: str = "doc_id", order: str = "ord", vector: str = "vector") -> DataFrame:
    """(group, order, leader, similarity): greedy clusters in order; one Python task per group."""
    types = dict(rows.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        v = np.array(pdf[vector].tolist(), np.float64)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        to, score = follow(v / np.where(norm == 0, 1, norm), least)
        keys = pdf[order].to_numpy()
        return pd.DataFrame({group: pdf[group], order: keys, "leader": keys[to], "similarity": score})

    return rows.select(group, order, vector).groupBy(group).applyInPandas(
        run, f"{group} {types[group]}, {order} {types[order]}, leader {types[order]}, similarity double"
    )


def similarity_pass(chunks: DataFrame, least: float = THRESHOLD) -> DataFrame:
    """Absorbs chunks (with a ``vector``) near an earlier survivor; templated and protected ones are exempt."""
    eligible = F.col("leader").isNull() & F.col("template").isNull() & ~F.col("kind").isin(*PROTECTED_KINDS) & F.col("vector").isNotNull()
    found = leader_clusters(chunks.where(eligible), least).where("leader <> ord")
    names = chunks.select(F.col("doc_id").alias("_d"), F.col("ord").alias("_o"), F.col("id").alias("_leader"))
    near = found.join(names, (F.col("doc_id") == F.col("_d")) & (F.col("leader") == F.col("_o"))).select(
        "doc_id", "ord", "_leader", F.col("similarity").alias("_similarity")
    )
    return chunks.join(near, ["doc_id", "ord"], "left").select(
        *[F.col(c) for c in chunks.columns if c not in ("leader", "method", "similarity")],
        F.coalesce("leader", "_leader").alias("leader"),
        F.coalesce("method", F.when(F.col("_leader").isNotNull(), F.lit("embedding"))).alias("method"),
        F.coalesce("similarity", "_similarity").alias("similarity"),
    )


def roots(chunks: DataFrame, passes: int = 3) -> DataFrame:
    """Adds ``root``: the survivor at the end of the leader chain, at most as long as there are passes."""
    step = chunks.where("leader is not null").select(F.col("doc_id").alias("_d"), F.col("id").alias("_i"), F.col("leader").alias("_l"))
    out = chunks.withColumn("root", F.coalesce("leader", "id"))
    for _ in range(passes - 1):
        out = (
            out.join(step, (F.col("doc_id") == F.col("_d")) & (F.col("root") == F.col("_i")), "left")
            .withColumn("root", F.coalesce("_l", "root"))
            .drop("_d", "_i", "_l")
        )
    return out


def clusters(chunks: DataFrame) -> DataFrame:
    """A row per root that absorbed others, from chunks with ``root``; cluster ids follow the roots' order."""
    members = chunks.where("leader is not null").groupBy("doc_id", F.col("root").alias("representative_id")).agg(
        F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("m"),
        F.count("*").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", _known(chunks, "label", label).alias("label")))), lambda x: x["label"]).alias("absorbed_symbols"),
        F.sum("token_count").alias("absorbed_tokens"),
        F.when(F.count_distinct("method") > 1, "mixed").otherwise(F.min("method")).alias("method"),
        F.avg("similarity").alias("mean_similarity"),
    )
    lead = chunks.select("doc_id", F.col("id").alias("representative_id"), F.col("ord").alias("_ord"))
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_ord")) - 1
    return members.join(lead, ["doc_id", "representative_id"]).select(
        "doc_id",
        number.alias("cluster_id"),
        "representative_id",
        F.transform("m", lambda x: x["id"]).alias("member_ids"),
        "absorbed_symbols",
        "absorbed_tokens",
        "method",
        "mean_similarity",
        (F.col("n") + 1).cast("int").alias("size"),
    )


def deduplicate(
    chunks: DataFrame, *, exact: bool = True, structural: bool = True, similar: float | None = None, min_shape_tokens: int = MIN_SHAPE_TOKENS
) -> DataFrame:
    """Chunks with leader, method, similarity and root; ``duplicate_count`` counts a root's occurrences."""
    out = unmarked(chunks)
    if exact:
        out = exact_pass(out)
    if structural:
        out = structural_pass(out, min_shape_tokens)
    if similar is not None and "vector" in chunks.columns:
        out = similarity_pass(out, similar)
    if similar is not None:
        out = roots(out)
    else:
        # The first of an exact key may have been absorbed by its shape; its leader hasn't been.
        same = Window.partitionBy("doc_id", _known(chunks, "dedup_key", dedup_key)).orderBy(F.col("kind").isin(*PROTECTED_KINDS), "ord")
        out = out.withColumn("root", F.coalesce(F.when(F.col("method") == "exact", F.first("leader").over(same)), "leader", "id"))
    return out.withColumn("duplicate_count", F.count("*").over(Window.partitionBy("doc_id", "root")).cast("int"))


def accounting(chunks: DataFrame) -> DataFrame:
    """Per document: tokens before and after, removed, and what the clusters claim; the last two agree."""
    gone = F.col("leader").isNotNull()
    total = chunks.groupBy("doc_id").agg(
        F.sum("token_count").alias("tokens_in"),
        F.sum(F.when(~gone, F.col("token_count")).otherwise(0)).alias("tokens_out"),
        F.count_if(gone).alias("absorbed"),
        *[F.count_if(F.col("method") == m).alias(f"by_{m}") for m in ("exact", "structural", "embedding")],
    )
    claimed = clusters(chunks).groupBy("doc_id").agg(
        F.sum("absorbed_tokens").alias("claimed"), F.count("*").alias("clusters"), F.max("size").alias("largest")
    )
    return total.join(claimed, "doc_id", "left").select(
        "*", (F.col("tokens_in") - F.col("tokens_out")).alias("removed")
    ).fillna(0, ["claimed", "clusters", "largest"])


def largest_clusters(found: DataFrame, limit: int) -> DataFrame:
    """Each document's ``limit`` clusters of most members, of equal ones the first; ``place`` counts from 1."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), "cluster_id"))
    return found.withColumn("place", place).where(F.col("place") <= limit)
