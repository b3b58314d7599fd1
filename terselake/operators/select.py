"""Choosing chunks under a token budget, with repair of broken symbol references.

Admission is greedy with skipping, so it is a fold over the document's chunks in order of value: an
``aggregate`` over one array per document, in the JVM. Repair and the loop that fits markers into the budget
depend on each choice before them and run per document in Python.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import text as T
from ..schema import CODE_KINDS, PROTECTED_KINDS
from . import rebuild
from .dedup import KEYWORDS, LEXER
from .stream import whole

RATIO = 0.30
RESERVE = 0.03
MIN_KEPT = 1
ROUNDS = 3
ATTEMPTS = 6
AUDIT = 50
# ---- fixed values: names too common to be a dependency ----
GENERIC = (
    "abs all any bool bytes callable chr dict dir enumerate filter float format frozenset getattr hasattr hash hex id input int "
    "isinstance issubclass items iter keys len list map max min next object open ord print range repr reversed round set setattr "
    "sorted str sum super tuple type vars zip values append add copy extend get index insert join pop push remove replace reverse "
    "sort split strip update write read close send test main self cls args kwargs error warn info debug log name value data result "
    "response request config"
).split()
MIN_NAME = 3
# ---- end of fixed values ----
KEPT = ("protected", "density", "dependency")


def budget(original: Column, ratio: float = RATIO) -> Column:
    return F.greatest(F.lit(1), F.rint(original * F.lit(ratio)).cast("int"))


def allowance(limit: Column, reserve: float = RESERVE) -> Column:
    return F.greatest(F.lit(1), F.floor(limit * F.lit(1 - reserve)).cast("int"))


BLOCK = 256


def fit_in_order(rows: Column, limit: Column, used: Column, kept: Column, least: int) -> Column:
    """Ids admitted from ``rows`` (array of struct with id and tokens) in order: those that still fit are taken and
    others passed over, and any are while fewer than ``least`` are kept. Ids gather in blocks, so that a step copies
    few of them however many there are."""
    none = F.array().cast("array<string>")
    start = F.struct(used.cast("long").alias("used"), kept.cast("int").alias("kept"), none.alias("ids"), F.array().cast("array<array<string>>").alias("full"))

    def take(s: Column, r: Column) -> Column:
        fits = (s["used"] + r["tokens"] <= limit) | (s["kept"] < least)
        size = [(s["used"] + r["tokens"]).alias("used"), (s["kept"] + 1).alias("kept")]
        more = F.struct(*size, F.concat(s["ids"], F.array(r["id"])).alias("ids"), s["full"].alias("full"))
        block = F.struct(*size, F.array(r["id"]).alias("ids"), F.concat(s["full"], F.array(s["ids"])).alias("full"))
        return F.when(fits & (F.size(s["ids"]) < BLOCK), more).when(fits, block).otherwise(s)

    return F.aggregate(rows, start, take, lambda s: F.concat(F.flatten(s["full"]), s["ids"]))


def select(
    chunks: DataFrame, originals: DataFrame, *, ratio: float = RATIO, strategy: str = "density", least: int = MIN_KEPT, seed: int = 1337
) -> DataFrame:
    """Adds ``selected`` and ``drop_reason`` to survivors, given ``originals`` (doc_id, original_tokens).

    ``density`` holds back a reserve for markers and admits protected chunks first; ``truncate`` takes them in
    document order and ``random`` in an order drawn by hash, both without reserve or protection.
    """
    least = least if strategy == "density" else 0
    if strategy not in ("density", "truncate", "random"):
        raise ValueError(f"no such strategy: {strategy}")
    protected = F.col("kind").isin(*PROTECTED_KINDS) if strategy == "density" else F.lit(False)
    key = {"density": -F.col("density") if strategy == "density" else None, "truncate": F.lit(0.0), "random": F.xxhash64("id", F.lit(seed)).cast("double")}[strategy]
    entry = F.struct(key.alias("key"), F.col("ord").alias("ord"), F.col("id").alias("id"), F.col("token_count").alias("tokens"))
    per = chunks.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(~protected, entry))).alias("rows"),
        F.coalesce(F.sum(F.when(protected, F.col("token_count"))), F.lit(0)).alias("used"),
        F.count_if(protected).alias("kept"),
    )
    limit = budget(F.col("original_tokens"), ratio)
    limit = allowance(limit) if strategy == "density" else limit
    chosen = per.join(originals, "doc_id").select("doc_id", fit_in_order(F.col("rows"), limit, F.col("used"), F.col("kept"), least).alias("_ids"))
    ids = chosen.select("doc_id", F.explode("_ids").alias("id"), F.lit(True).alias("_in"))
    reason = F.when(protected, "protected").when(F.col("_in"), "density").otherwise("budget_exhausted")
    return chunks.join(ids, ["doc_id", "id"], "left").select(
        *chunks.columns, (protected | F.coalesce("_in", F.lit(False))).alias("selected"), reason.alias("drop_reason")
    )


def _names(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(LEXER), F.lit(0))
    return F.filter(tokens, lambda t: t.rlike("^[A-Za-z_$][A-Za-z0-9_$]*$"))


def definitions(chunks: DataFrame) -> DataFrame:
    """(doc_id, id, name): what code chunks define; ``A.b`` defines itself, ``A`` and ``b``."""
    parts = F.concat(F.array("symbol"), F.split("symbol", r"\."))
    named = chunks.where(F.col("kind").isin(*CODE_KINDS) & F.col("symbol").isNotNull())
    return named.select("doc_id", "id", F.explode(F.array_distinct(parts)).alias("name")).where(F.length("name") >= MIN_NAME)


def references(chunks: DataFrame) -> DataFrame:
    """(doc_id, id, name): names that code chunks use, other than their own, keywords and generic ones."""
    attributes = F.regexp_extract_all("text", F.lit(r"\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    own = F.when(F.col("symbol").isNotNull(), F.concat(F.array("symbol"), F.split("symbol", r"\."))).otherwise(F.array().cast("array<string>"))
    skip = F.array(*[F.lit(w) for w in [*KEYWORDS, *GENERIC]])
    names = F.array_except(F.array_except(F.array_union(_names(F.col("text")), attributes), skip), own)
    return chunks.where(F.col("kind").isin(*CODE_KINDS)).select("doc_id", "id", F.explode(names).alias("name")).where(F.length("name") >= MIN_NAME)


def named(chunks: DataFrame) -> DataFrame:
    """Adds ``defines`` and ``uses``, the sorted names of :func:`definitions` and :func:`references`, empty where there are none."""
    none = F.array().cast("array<string>")
    parts = F.when(F.col("symbol").isNotNull(), F.concat(F.array("symbol"), F.split("symbol", r"\."))).otherwise(none)
    attributes = F.regexp_extract_all("text", F.lit(r"\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    skip = F.array(*[F.lit(w) for w in [*KEYWORDS, *GENERIC]])
    uses = F.array_except(F.array_except(F.array_union(_names(F.col("text")), attributes), skip), parts)
    long = lambda names: F.sort_array(F.filter(names, lambda n: F.length(n) >= MIN_NAME))
    code = F.col("kind").isin(*CODE_KINDS)
    of = lambda names: F.coalesce(F.when(code, long(names)), none)
    return chunks.withColumns({"defines": of(F.array_distinct(parts)), "uses": of(uses)})


def broken(chunks: DataFrame) -> DataFrame:
    """(doc_id, referrer_id, symbol, definition_id, definition_tokens): names a kept chunk uses whose every
    definition was dropped; the smallest definition mends it."""
    defs = definitions(chunks).join(chunks.select("doc_id", "id", "token_count", "ord", "selected"), ["doc_id", "id"])
    refs = references(chunks).join(chunks.where("selected").select("doc_id", "id"), ["doc_id", "id"])
    kept = defs.where("selected").select("doc_id", "name").distinct()
    open_ = refs.join(kept, ["doc_id", "name"], "left_anti")
    smallest = defs.groupBy("doc_id", "name").agg(F.min(F.struct("token_count", "ord", "id")).alias("d"))
    return open_.join(smallest, ["doc_id", "name"]).select(
        "doc_id", F.col("id").alias("referrer_id"), F.col("name").alias("symbol"), F.col("d.id").alias("definition_id"),
        F.col("d.token_count").alias("definition_tokens"),
    )


def audit(chunks: DataFrame, limit: int = AUDIT) -> DataFrame:
    """The dropped chunks of highest density."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("density"), "ord"))
    return chunks.where("not selected").withColumn("rank", rank).where(F.col("rank") <= limit)


def metrics(chunks: DataFrame, originals: DataFrame, ratio: float = RATIO) -> DataFrame:
    used = F.sum(F.when(F.col("selected"), F.col("token_count")).otherwise(0))
    out = chunks.groupBy("doc_id").agg(
        F.sum("token_count").alias("tokens_in"), used.alias("tokens_out"), F.count_if("selected").alias("kept"),
        F.count_if(~F.col("selected")).alias("dropped"),
    ).join(originals, "doc_id")
    return out.withColumn("budget", budget(F.col("original_tokens"), ratio)).withColumn("utilisation", F.col("tokens_out") / F.col("budget"))


def rewrite_candidates(chunks: DataFrame, least: int = 150, limit: int = 12) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("token_count"), "ord"))
    fits = F.col("selected") & ~F.col("kind").isin(*PROTECTED_KINDS) & (F.col("token_count") >= least)
    return chunks.where(fits).withColumn("rank", rank).where(F.col("rank") <= limit)


# ---- the whole loop for one document ----


class Picker:
    """Admission, repair and marker fitting over one document's survivors, as lists sorted by ord."""

    def __init__(self, rows: list[dict] | pd.DataFrame, limit: int):
        self.rows = rows if isinstance(rows, list) else rows.sort_values("ord").to_dict("records")
        self.limit = limit
        for r in self.rows:
            r["protected"] = r["kind"] in PROTECTED_KINDS
        self.by_id = {r["id"]: r for r in self.rows}
        self.defined = defaultdict(list)
        for r in self.rows:
            for n in r["defines"]:
                self.defined[n].append(r["id"])

    def admit(self, allowed: int, least: int) -> set[str]:
        kept = {r["id"] for r in self.rows if r["protected"]}
        used = sum(self.by_id[i]["token_count"] for i in kept)
        for r in self.rows:
            r["reason"] = "protected" if r["protected"] else "budget_exhausted"
        for r in sorted((r for r in self.rows if not r["protected"]), key=lambda r: (-r["density"], r["ord"])):
            if used + r["token_count"] <= allowed or len(kept) < least:
                kept.add(r["id"])
                used += r["token_count"]
                r["reason"] = "density"
        return kept

    def demands(self, kept: set[str]) -> dict[str, set[str]]:
        """Definition to add -> the kept chunks that need it."""
        wanted = defaultdict(set)
        for i in kept:
            for n in self.by_id[i]["uses"]:
                have = self.defined.get(n, [])
                if have and not kept.intersection(have):
                    wanted[min(have, key=lambda d: (self.by_id[d]["token_count"], self.by_id[d]["ord"]))].add(i)
        return wanted

    def holds_up(self, i: str, kept: set[str]) -> bool:
        """Whether dropping ``i`` would break a reference that ``kept`` satisfies."""
        for n in self.by_id[i]["defines"]:
            if kept.intersection(self.defined[n]) == {i} and any(n in self.by_id[k]["uses"] for k in kept if k != i):
                return True
        return False

    def repair(self, kept: set[str], allowed: int) -> None:
        for _ in range(ROUNDS):
            changed = False
            todo = sorted(self.demands(kept).items(), key=lambda kv: (-len(kv[1]), self.by_id[kv[0]]["token_count"], self.by_id[kv[0]]["ord"]))
            for target, users in todo:
                users = users & kept
                if target in kept or not users:
                    continue
                need = sum(self.by_id[i]["token_count"] for i in kept) + self.by_id[target]["token_count"] - allowed
                worth = max(self.by_id[u]["density"] for u in users)
                out: set[str] = set()
                for r in sorted((self.by_id[i] for i in kept), key=lambda r: (r["density"], -r["token_count"], r["ord"])):
                    if need <= 0:
                        break
                    if r["protected"] or r["id"] in users or r["density"] > worth or self.holds_up(r["id"], kept - out):
                        continue
                    out.add(r["id"])
                    need -= r["token_count"]
                if need > 0:
                    continue
                kept -= out
                kept.add(target)
                for i in out:
                    self.by_id[i]["reason"] = "evicted_for_dependency"
                self.by_id[target]["reason"] = "dependency"
                changed = True
            if not changed:
                return

    def run(self, least: int, reserve: float, mend: bool, markers: bool) -> list[dict]:
        allowed = max(1, int(self.limit * (1 - reserve)))
        best = None
        for _ in range(ATTEMPTS):
            kept = self.admit(allowed, least)
            if mend:
                self.repair(kept, allowed)
            size = rebuild.measure(self.rows, kept, markers)
            now = (size > self.limit, size if size > self.limit else -size, [(r["id"], r["id"] in kept, r["reason"]) for r in self.rows])
            if best is None or now[:2] < best[:2]:
                best = now
            if size <= self.limit:
                break
            free = [self.by_id[i]["token_count"] for i in kept if not self.by_id[i]["protected"]]
            if not free:
                break
            used = sum(self.by_id[i]["token_count"] for i in kept)
            lower = allowed - (size - self.limit + 1)
            allowed = max(1, min(lower, used - min(free) if lower >= used else lower))
            least = min(least, max(1, len(kept) - 1))
        return best[2]


def select_with_repair(
    chunks: DataFrame, originals: DataFrame, *, ratio: float = RATIO, least: int = MIN_KEPT, reserve: float = RESERVE, mend: bool = True, markers: bool = True
) -> DataFrame:
    """Like :func:`select` by density, with dependencies mended and the budget met with markers counted in."""
    known = chunks if "uses" in chunks.columns else named(chunks)
    known = known if "words" in chunks.columns else known.withColumn("words", T.word_count("text"))
    limits = originals.select("doc_id", budget(F.col("original_tokens"), ratio).alias("_limit"))
    # A document's rows meet in one partition, in order, and leave it with their columns.
    rows = known.join(limits, "doc_id").repartition("doc_id").sortWithinPartitions("doc_id", "ord")
    kept = chunks.columns
    read = ["id", "ord", "kind", "symbol", "token_count", "density", "start_line", "end_line", "words", "duplicate_count", "cluster_id", "absorbed_tokens", "method", "defines", "uses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches):
            records, limit = t.select(read).to_pylist(), t.column("_limit").to_pylist()
            chosen = []
            for _, group in groupby(zip(t.column("doc_id").to_pylist(), range(t.num_rows), strict=True), key=lambda x: x[0]):
                at = [i for _, i in group]
                chosen += Picker([records[i] for i in at], limit[at[0]]).run(least, reserve, mend, markers)
            out = t.select(kept).append_column("selected", pa.array([c[1] for c in chosen], pa.bool_()))
            yield from out.append_column("drop_reason", pa.array([c[2] for c in chosen], pa.string())).combine_chunks().to_batches()

    added = [StructField("selected", BooleanType()), StructField("drop_reason", StringType())]
    return rows.mapInArrow(run, StructType([*chunks.schema.fields, *added]))
