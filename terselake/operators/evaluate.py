"""Evaluation without a model, and the arithmetic around answers that a model gave elsewhere."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Dollars for a million tokens, in and out.
PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "claude-sonnet-4-5": (3.00, 15.00)}
DEFAULT_MODEL = "gpt-4o-mini"
#: Tokens that a local model reads; a longer prompt would be cut without a word.
WINDOW = 16384
#: Judge calls that may fail one after another.
FAILURES = 3


def validate(items: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, problem) of items (id, context, key_facts) that can't be scored against contexts (context, text)."""
    twice = items.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    unknown = items.join(contexts, "context", "left_anti").select("id", F.lit("unknown context").alias("problem"))
    bare = items.where(F.coalesce(F.size("key_facts"), F.lit(0)) <= 0).select("id", F.lit("no facts").alias("problem"))
    absent = items.join(contexts, "context").where(F.exists("key_facts", lambda f: ~T.fact_present("text", f))).select("id", F.lit("fact not in context").alias("problem"))
    return twice.unionByName(unknown).unionByName(bare).unionByName(absent)


def missing_facts(text: str, facts: str = "key_facts") -> Column:
    """Labels of the facts that a text lacks, alternatives joined by a slash."""
    return F.transform(F.filter(facts, lambda f: ~T.fact_present(text, f)), lambda f: F.array_join(f, "/"))


def key_fact_recall(text: str, facts: str = "key_facts") -> Column:
    n = F.coalesce(F.size(facts), F.lit(0))
    return F.when(n <= 0, 0.0).otherwise(1 - F.size(missing_facts(text, facts)) / n)


def fact_survival(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Facts present in ``texts`` (context, text), for each context and over all (context null)."""
    rows = items.join(texts, "context").select("context", F.size("key_facts").alias("facts"), (F.size("key_facts") - F.size(missing_facts("text"))).alias("present"))
    return rows.rollup("context").agg(F.sum("present").alias("present"), F.sum("facts").alias("facts")).withColumn("survival", F.col("present") / F.col("facts"))


def verdict(before: Column, after: Column) -> Column:
    return F.when(after > before, "improved").when(after < before, "degraded").otherwise("retained")


def prices(spark: SparkSession, table: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in (table or PRICES).items()], "model string, input_per_1m double, output_per_1m double")


def cost(runs: DataFrame, price: DataFrame) -> DataFrame:
    """Adds ``cost`` in dollars to runs (model, tokens_in, tokens_out); a model without a price is an error."""
    dollars = (F.col("tokens_in") * F.col("input_per_1m") + F.col("tokens_out") * F.col("output_per_1m")) / 1e6
    known = F.when(F.col("input_per_1m").isNull(), F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("double"))
    both = runs.join(F.broadcast(price), "model", "left")
    return both.withColumn("cost", F.coalesce(known, dollars)).drop("input_per_1m", "output_per_1m")


def compare_arms(runs: DataFrame) -> DataFrame:
    """One row per item of runs (item_id, arm original|compressed, tokens_in, latency_ms, recall, cost, error)."""
    side = lambda a: runs.where(F.col("arm") == a).select("item_id", *[F.col(c).alias(f"{a[:4]}_{c}") for c in ("tokens_in", "latency_ms", "recall", "cost", "error")])
    both = side("original").join(side("compressed"), "item_id")
    return both.select(
        "*",
        (F.col("orig_tokens_in") - F.col("comp_tokens_in")).alias("tokens_saved"),
        ratio(F.col("orig_cost"), F.col("comp_cost")).alias("cost_reduction"),
        F.when(F.col("comp_latency_ms") > 0, F.col("orig_latency_ms") / F.col("comp_latency_ms")).alias("speedup"),
        verdict(F.col("orig_recall"), F.col("comp_recall")).alias("verdict"),
        (F.coalesce(T.is_too_large("orig_error"), F.lit(False)) & F.col("comp_error").isNull()).alias("unlocked"),
    )


def ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, 1 - after / before).otherwise(0.0)


def report(arms: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c)
    return arms.agg(
        F.count("*").alias("items"),
        total("orig_tokens_in").alias("original_tokens"),
        total("comp_tokens_in").alias("compressed_tokens"),
        ratio(total("orig_tokens_in"), total("comp_tokens_in")).alias("compression"),
        ratio(total("orig_cost"), total("comp_cost")).alias("cost_reduction"),
        F.when(total("comp_latency_ms") > 0, total("orig_latency_ms") / total("comp_latency_ms")).alias("speedup"),
        F.avg("orig_recall").alias("original_recall"),
        F.avg("comp_recall").alias("compressed_recall"),
        F.when(F.avg("orig_recall") > 0, F.avg("comp_recall") / F.avg("orig_recall")).otherwise(0.0).alias("retention"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("retained", "improved", "degraded")],
    )


def context_summary(rows: DataFrame) -> DataFrame:
    """Mean tokens per context over its questions' compressions."""
    return rows.groupBy("context").agg(
        F.rint(F.avg("original_tokens")).cast("long").alias("original_tokens"),
        F.rint(F.avg("compressed_tokens")).cast("long").alias("compressed_tokens"),
        ratio(F.avg("original_tokens"), F.avg("compressed_tokens")).alias("compression"),
    )


def judge_reply(reply: Column | str) -> Column:
    """The ``correct`` of the JSON object in a judge's reply; null if there is none."""
    found = F.regexp_extract(F.col(reply) if isinstance(reply, str) else reply, r"(?s)\{.*\}", 0)
    return F.get_json_object(found, "$.correct").cast("boolean")


def judged(answers: Iterable[str | None], ask: Callable[[str], str | None]) -> list[bool | None]:
    """What a judge says of each answer; None without an answer or a reply. It is asked no more after FAILURES failures in a row."""
    out: list[bool | None] = []
    failed = 0
    for answer in answers:
        reply = ask(answer) if failed < FAILURES and (answer or "").strip() else None
        if failed < FAILURES and (answer or "").strip():
            failed = failed + 1 if reply is None else 0
        found = re.search(r"(?s)\{.*\}", reply or "")
        try:
            said = json.loads(found[0]).get("correct") if found else None
        except (ValueError, AttributeError):
            said = None
        out.append(None if said is None else bool(said))
    return out


def diagnostic_candidates(rows: DataFrame) -> DataFrame:
    """Items whose facts are all in the compressed context though the answer missed some."""
    return rows.where((F.size(missing_facts("context_text")) == 0) & (F.size(missing_facts("answer")) > 0))


def diagnosis(rows: DataFrame) -> DataFrame:
    """(items, resolved, verdict) over items (resolved boolean): whose fault misses are, by the share a stronger model resolves."""
    n, good = F.count("*"), F.count_if("resolved")
    most = F.greatest(F.lit(1), F.floor(n / 2))
    return rows.agg(
        n.alias("items"), good.alias("resolved"), F.when(good >= most, "retrieval-bound").when(good > 0, "mixed").otherwise("not retrieval-bound").alias("verdict")
    )


def fits_window(tokens: Column | str, num_ctx: int = WINDOW) -> Column:
    return (F.col(tokens) if isinstance(tokens, str) else tokens) <= num_ctx


def guard_window(items: DataFrame, local: bool, num_ctx: int = WINDOW) -> DataFrame:
    """``items`` (id, original_tokens), which fail when read if a local model would cut one's original context."""
    if not local:
        return items
    message = F.format_string(f"%s: %d tokens are more than the {num_ctx} that the model reads", F.col("id").cast("string"), F.col("original_tokens"))
    checked = F.when(fits_window("original_tokens", num_ctx), F.col("original_tokens")).otherwise(F.raise_error(message).cast("int"))
    return items.withColumn("original_tokens", checked)


def finalize(stored: DataFrame, survival: DataFrame) -> DataFrame:
    """A stored report's items with survival recomputed."""
    keep = [c for c in stored.columns if c not in ("present", "facts", "survival")]
    return stored.select(*keep).join(survival.where("context is not null"), "context", "left")


def by_provider(runs: DataFrame) -> DataFrame:
    return runs.groupBy("provider").agg(F.count("*").alias("items"), F.when(F.avg("orig_recall") > 0, F.avg("comp_recall") / F.avg("orig_recall")).otherwise(0.0).alias("retention"))
