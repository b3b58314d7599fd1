"""Rewriting long chunks with a model, and the checks that a rewrite has to pass."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .embed import Chain
from .select import rewrite_candidates

OVERLAP = 0.90
CALL_SECONDS, STAGE_SECONDS, LEAST_SECONDS = 10.0, 12.0, 2.5


def verdicts(rewrites: DataFrame, overlap: float = OVERLAP, numbers: bool = True) -> DataFrame:
    """Adds ``accepted``, ``reason`` and ``rewritten`` to rows of original, candidate and token_count."""
    new = T.strip_fences("candidate")
    wanted, have = T.critical_tokens("original"), T.critical_tokens(new)
    lost = F.size(F.array_except(T.numbers_in("original"), T.numbers_in(new)))
    share = F.size(F.array_intersect(wanted, have)) / F.size(wanted)
    reason = (
        F.when(F.col("candidate").isNull() | (F.col("candidate") == ""), "no_response")
        .when(F.trim(new) == "", "empty_response")
        .when(T.token_count(new) >= F.col("token_count"), "no_gain")
        .when(F.lit(numbers) & (lost > 0), "numbers_lost")
        .when((F.size(wanted) > 0) & (share < overlap), "entity_overlap")
    )
    return rewrites.withColumns({"reason": reason, "accepted": reason.isNull(), "rewritten": F.when(reason.isNull(), new)})


def rejections(judged: DataFrame) -> DataFrame:
    return judged.where("not accepted").groupBy("reason").agg(F.count("*").alias("n"))


def rejection_rate(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("attempted"), F.avg((~F.col("accepted")).cast("int")).alias("rate"))


def saved(judged: DataFrame) -> DataFrame:
    gain = F.when(F.col("accepted"), F.greatest(F.lit(0), F.col("token_count") - T.token_count("rewritten"))).otherwise(0)
    return judged.groupBy("doc_id").agg(F.sum(gain).alias("saved"), F.count_if("accepted").alias("accepted"), F.count("*").alias("attempted"))


def rewrite(
    chunks: DataFrame, generate: Callable[[str, float], str | None] | Chain | None, *, enabled: bool = True, fast: bool = False,
    stage_seconds: float = STAGE_SECONDS, least: int = 150, limit: int = 12, overlap: float = OVERLAP, numbers: bool = True,
) -> tuple[DataFrame, DataFrame, str | None]:
    """(chunks with ``compressed_text``, judged rewrites, why it was skipped). ``generate`` is called on executors
    with a text and its seconds, and returns None when it has no answer; a document's calls share its time. A chain of
    generators is asked in its order, and a chain that is exhausted has no answer."""
    if isinstance(generate, Chain):
        chain = generate
        if not chain.available:
            generate = None
        else:
            generate = lambda text, seconds: (chain.try_run(text, seconds) or (None, None))[1]
    why = "fast mode" if fast else "disabled" if not enabled else "no model is available" if generate is None else None
    long = rewrite_candidates(chunks, least, limit).select("doc_id", "id", F.col("text").alias("original"), "token_count")
    if why:
        empty = long.withColumn("candidate", F.lit(None).cast("string")).limit(0)
        return chunks.withColumn("compressed_text", F.lit(None).cast("string")), verdicts(empty, overlap, numbers), why

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        began, out = time.monotonic(), []
        for text in pdf["original"]:
            left = stage_seconds - (time.monotonic() - began)
            try:
                out.append(generate(text, min(CALL_SECONDS, left)) if left >= LEAST_SECONDS else None)
            except Exception:
                out.append(None)
        return pdf.assign(candidate=pd.Series(out, index=pdf.index, dtype=object))

    judged = verdicts(long.groupBy("doc_id").applyInPandas(run, "doc_id bigint, id string, original string, token_count int, candidate string"), overlap, numbers)
    new = judged.where("accepted").select("doc_id", "id", F.col("rewritten").alias("compressed_text"))
    return chunks.join(new, ["doc_id", "id"], "left"), judged, None
