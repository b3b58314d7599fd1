"""How much a chunk says: six signals, scaled within the document, and their weighted sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import text as T
from ..schema import PROTECTED_KINDS, STRUCTURAL_KINDS
from .dedup import MIN_SHAPE_TOKENS
from .embed import centroid, cosine, dot, norm
from .stream import whole

# ---- fixed values ----
WEIGHTS = {"entropy": 0.12, "tfidf": 0.20, "entities": 0.12, "novelty": 0.16, "structure": 0.20, "query_relevance": 0.20}
FREQUENCY_BOOST = 0.05
KIND_PRIORS = {
    "query": 1.0, "instruction": 1.0, "system": 1.0, "function": 0.70, "method": 0.70, "class": 0.70, "class_header": 0.60,
    "code_block": 0.60, "paragraph": 0.50, "list": 0.50, "heading": 0.50, "log_record": 0.40, "module_level": 0.60,
    "sentence": 0.40, "other": 0.30,
}
DEFAULT_PRIOR = 0.40
LEVEL_PRIORS = {
    "CRITICAL": 1.0, "FATAL": 1.0, "SEVERE": 1.0, "ERROR": 0.95, "WARNING": 0.80, "WARN": 0.80, "NOTICE": 0.50, "INFO": 0.35,
    "DEBUG": 0.20, "TRACE": 0.15,
}
KEYWORDS = (
    "traceback", "exception", "stacktrace", "caused by", "panic", "timeout", "timed out", "failed", "failure", "refused",
    "denied", "exhausted", "corrupt", "deadlock", "root cause", "regression", "rollback", "outage", "incident", "breach",
    "data loss",
)
KEYWORD_BOOST = 0.25
NO_BOOST = ("function", "method", "class", "class_header", "module_level")
ENTROPY_TOKENS = 64
NER_CHARS = 400_000
# ---- end of fixed values ----

KEY = ["doc_id", "id"]


def analysis_text() -> Column:
    return F.coalesce(F.regexp_replace("template", T.TEMPLATE_MARKS, " "), F.col("text"))


def entropy_of(text: Column) -> Column:
    """Shannon entropy of a text's tokens over its maximum, damped below ENTROPY_TOKENS: a fold over its sorted tokens."""
    bits = lambda n: F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)
    start = F.struct(F.lit("").alias("token"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0).alias("all"))

    def step(s: Column, t: Column) -> Column:
        again = F.struct(t.alias("token"), (s["n"] + 1).alias("n"), s["sum"].alias("sum"), (s["all"] + 1).alias("all"))
        other = F.struct(t.alias("token"), F.lit(1).alias("n"), (s["sum"] + bits(s["n"])).alias("sum"), (s["all"] + 1).alias("all"))
        return F.when(t == s["token"], again).otherwise(other)

    def finish(s: Column) -> Column:
        most = F.log2(s["all"].cast("double"))
        damp = F.least(F.lit(1.0), most / F.log2(F.lit(float(ENTROPY_TOKENS))))
        return F.when(s["all"] < 2, 0.0).otherwise((most - (s["sum"] + bits(s["n"])) / s["all"]) / most * damp)

    return F.coalesce(F.aggregate(F.sort_array(T.token_list(text)), start, step, finish), F.lit(0.0))


def entropy(chunks: DataFrame) -> DataFrame:
    """(doc_id, id, entropy), row by row."""
    return chunks.select(*KEY, entropy_of(analysis_text()).alias("entropy"))


def tfidf(chunks: DataFrame) -> DataFrame:
    """(doc_id, id, tfidf): mean over a chunk's terms of (1 + ln tf) * smoothed idf; null where it has no sense."""
    terms = chunks.select(*KEY, F.explode(F.regexp_extract_all(F.lower(analysis_text()), F.lit(T.TERM), F.lit(0))).alias("term"))
    tf = terms.groupBy(*KEY, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    idf = F.log((1 + F.col("chunks")) / (1 + F.col("df"))) + 1
    mean = tf.join(df, ["doc_id", "term"]).join(n, "doc_id").groupBy(*KEY).agg(F.avg((1 + F.log("tf")) * idf).alias("tfidf"))
    sized = chunks.select(*KEY).join(n, "doc_id").join(mean, KEY, "left")
    some = F.count("tfidf").over(Window.partitionBy("doc_id")) > 0
    return sized.select(*KEY, F.when((F.col("chunks") >= 2) & some, F.coalesce("tfidf", F.lit(0.0))).alias("tfidf"))


def entities() -> Column:
    text = analysis_text()
    return T.entity_weight(T.entity_counts(text)) / F.greatest(F.lit(1), T.token_count(text))


def entity_backend(chunks: DataFrame) -> DataFrame:
    """(doc_id, backend): why names come from patterns only."""
    return chunks.groupBy("doc_id").agg(
        F.when(F.sum(F.length("text")) > NER_CHARS, "regex:oversized").otherwise("regex:unavailable").alias("backend")
    )


def structure() -> Column:
    """The prior of the level or else the kind, more where failure words stand; never above 1, never rescaled."""
    pick = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])
    prior = F.coalesce(F.try_element_at(pick(LEVEL_PRIORS), F.upper("level")), F.try_element_at(pick(KIND_PRIORS), F.col("kind")), F.lit(DEFAULT_PRIOR))
    low = F.lower("text")
    hits = F.size(F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(low, k)))
    boost = F.when(F.col("kind").isin(*NO_BOOST), 0.0).otherwise(KEYWORD_BOOST * F.least(F.lit(1.0), hits / 2))
    return F.least(F.lit(1.0), prior + boost)


def novelty(chunks: DataFrame, group: str = "doc_id", vector: str = "vector") -> DataFrame:
    """Adds ``novelty``: 1 - cosine to the group's normalised centroid; .5 where that is zero, null without a vector."""
    mean = centroid(chunks.where(F.col(vector).isNotNull()), group, vector)
    both = chunks.join(mean, group, "left")
    value = F.when(F.col(vector).isNull(), None).when(norm(F.col("centroid")) == 0, 0.5).otherwise(
        1 - dot(F.col(vector), F.col("centroid")) / norm(F.col("centroid"))
    )
    return both.withColumn("novelty", value).drop("centroid")


def query_relevance(vector: Column, query: Column) -> Column:
    """Cosine to the question's vector, from 0 to 1; null if either is missing or their lengths differ."""
    fits = vector.isNotNull() & query.isNotNull() & (F.size(vector) == F.size(query))
    return F.when(fits, (cosine(vector, query) + 1) / 2)


def frequency() -> Column:
    """What a representative stands for: log of its absorbed copies over the document's largest."""
    own = F.log1p(F.col("duplicate_count") - 1)
    most = F.max(own).over(Window.partitionBy("doc_id"))
    return F.when(most > 0, own / most).otherwise(0.0)


def scaled(c: str, group: str = "doc_id") -> Column:
    """To [0, 1] in the group: by extremes below 8 values, else by the 5th and 95th percentile; .5 if all are alike."""
    w = Window.partitionBy(group)
    few = F.count(c).over(w) < 8
    low = F.when(few, F.min(c).over(w)).otherwise(F.percentile(c, F.lit(0.05)).over(w))
    high = F.when(few, F.max(c).over(w)).otherwise(F.percentile(c, F.lit(0.95)).over(w))
    x = F.when(high - low < 1e-9, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - low) / (high - low))))
    return F.when(F.col(c).isNotNull(), x)


def asked_vector() -> Column:
    """The vector of the document's own question, which is one of its protected chunks and was embedded with them."""
    return F.first(F.when(F.col("kind") == "query", F.col("vector")), ignorenulls=True).over(Window.partitionBy("doc_id"))


#: What :func:`measured` adds to chunks, so that :func:`score` needs no text.
MEASURED = ("entropy", "entities", "structure", "tfidf")
#: And the words of the whole text, and of the text without white space at its end.
SIZED = ("words", "body_words")


def _counts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n) of the different strings of each row's list; equal strings have equal codes."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    different = max(1, len(coded.dictionary))
    keys = np.repeat(np.arange(len(lists), dtype=np.int64), sizes) * different + coded.indices.to_numpy(zero_copy_only=False)
    keys, n = np.unique(keys, return_counts=True)
    return keys // different, keys % different, n


def _entropies(tokens: pa.ListArray, total: np.ndarray) -> np.ndarray:
    """As :func:`entropy_of`."""
    row, _, n = _counts(tokens)
    bits = np.bincount(row, n * np.log2(n), len(tokens))
    many = np.maximum(total, 2)
    most = np.log2(many)
    return np.where(total < 2, 0.0, (most - bits / many) / most * np.minimum(1.0, most / np.log2(ENTROPY_TOKENS)))


def _tfidfs(terms: pa.ListArray, doc: np.ndarray, live: np.ndarray) -> pa.Array:
    """As :func:`tfidf` over the live rows, given whole documents numbered from 0; null for others."""
    at = np.flatnonzero(live)
    row, code, tf = _counts(terms.take(pa.array(at)))
    mine = doc[at]
    wide = code.max(initial=0) + 1
    _, back, df = np.unique(mine[row] * wide + code, return_inverse=True, return_counts=True)
    chunks = np.bincount(mine, minlength=doc[-1] + 1)
    idf = np.log((1 + chunks[mine[row]]) / (1 + df[back])) + 1
    sums, n = np.bincount(row, (1 + np.log(tf)) * idf, len(at)), np.bincount(row, minlength=len(at))
    some = np.bincount(mine, n > 0, doc[-1] + 1) > 0
    out, known = np.zeros(len(doc)), np.zeros(len(doc), bool)
    out[at] = sums / np.maximum(n, 1)
    known[at] = (some & (chunks >= 2))[mine]
    return pa.array(out, mask=~known)


def _alive(t: pa.Table, doc: np.ndarray, exact: bool, structural: bool, least: int) -> np.ndarray:
    """Which rows the passes by key of :mod:`dedup` leave: of equal keys in a document the first."""
    seen: set[tuple] = set()
    live = np.ones(len(doc), bool)
    kinds, keys, shapes, sizes = (t.column(c).to_pylist() for c in ("kind", "dedup_key", "signature", "token_count"))
    for i in np.lexsort((t.column("ord").to_numpy(), doc)).tolist():
        found = [(doc[i], 0, keys[i])] if exact and keys[i] is not None and kinds[i] not in PROTECTED_KINDS else []
        if structural and shapes[i] is not None and kinds[i] in STRUCTURAL_KINDS and sizes[i] >= least:
            found.append((doc[i], 1, shapes[i]))
        for key in found:
            if key in seen:
                live[i] = False
                break
            seen.add(key)
    return live


def measured(chunks: DataFrame, *, together: bool = False, exact: bool = True, structural: bool = True, min_shape_tokens: int = MIN_SHAPE_TOKENS) -> DataFrame:
    """Adds the signals that follow from the text to chunks with the keys of ``dedup.keyed``.

    ``tfidf`` follows from a document's survivors; it is among them if each document's rows stand ``together`` in one
    partition, as a chunker leaves them, and the passes by key alone decide who survives.
    """
    text = analysis_text()
    weight = T.entity_weight(T.entity_counts(text))
    terms = F.regexp_extract_all(F.lower(text), F.lit(T.TERM), F.lit(0)) if together else F.array().cast("array<string>")
    rows = chunks.withColumns({"structure": structure(), "_weight": weight, "_tokens": T.token_list(text), "_terms": terms})
    # A text's words are its tokens, unless the tokens are those of its template or white space that they count ends it.
    ends = F.substring("text", -1, 1).rlike(r"(?U)\s")
    body = T.word_count(F.regexp_replace("text", r"(?U)\s+$", ""))
    rows = rows.withColumns({"_words": F.when(F.col("template").isNotNull(), T.word_count("text")), "_body": F.when(ends, body)})
    added = MEASURED if together else MEASURED[:-1]
    extra = ["_weight", "_tokens", "_terms", "_words", "_body", "structure"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches) if together else map(lambda b: pa.Table.from_batches([b]), batches):
            if not t.num_rows:
                continue
            tokens, many = t.column("_tokens").combine_chunks(), t.column("_terms").combine_chunks()
            total = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            per = np.maximum(1.0, np.rint(total * T.TOKENS_PER_WORD))
            out = t.drop_columns(extra)
            words = pc.coalesce(t.column("_words"), pa.array(total, pa.int32()))
            out = out.append_column("words", words).append_column("body_words", pc.coalesce(t.column("_body"), words))
            out = out.append_column("entropy", pa.array(_entropies(tokens, total)))
            out = out.append_column("entities", pc.divide(t.column("_weight"), pa.array(per)))
            out = out.append_column("structure", t.column("structure"))
            if together:
                ids = t.column("doc_id").to_pylist()
                doc = np.cumsum([0, *(a != b for a, b in zip(ids, ids[1:], strict=False))])
                out = out.append_column("tfidf", _tfidfs(many, doc, _alive(t, doc, exact, structural, min_shape_tokens)))
            yield from out.combine_chunks().to_batches()

    schema = StructType([*chunks.schema.fields, *(StructField(c, IntegerType()) for c in SIZED), *(StructField(c, DoubleType()) for c in added)])
    return rows.mapInArrow(run, schema)


def score(survivors: DataFrame, *, weights: dict[str, float] | None = None, boost: float = FREQUENCY_BOOST) -> DataFrame:
    """Adds the scaled signals, ``density`` (6 digits) and ``density_parts`` (4). Signals a document lacks pass
    their weight to the others; relevance is that to the document's question. Signals that :func:`measured` has
    found are read and left out of the result."""
    weights = weights or WEIGHTS
    base = survivors
    if "vector" in base.columns:
        base = novelty(base).withColumn("_asked", asked_vector())
        relevance = query_relevance(F.col("vector"), F.col("_asked"))
    else:
        base, relevance = base.withColumn("novelty", F.lit(None).cast("double")), F.lit(None).cast("double")
    raw = base.withColumn("query_relevance", relevance)
    if "tfidf" not in survivors.columns:
        raw = raw.join(tfidf(survivors), KEY)
    row_wise = {"entropy": lambda: entropy_of(analysis_text()), "entities": entities, "structure": structure, "frequency": frequency}
    for name, value in row_wise.items():
        if name not in survivors.columns:
            raw = raw.withColumn(name, value())
    parts = {k: F.col(k) if k == "structure" else scaled(k) for k in WEIGHTS}
    out = raw.withColumns({f"n_{k}": v for k, v in parts.items()})
    there = {k: F.col(f"n_{k}").isNotNull() for k in WEIGHTS}
    total = sum((F.when(there[k], weights.get(k, 0.0)).otherwise(0.0) for k in WEIGHTS), F.lit(0.0))
    count = sum((there[k].cast("int") for k in WEIGHTS), F.lit(0))
    # Uniform where all weights present are zero.
    weight = lambda k: F.when(total > 0, F.lit(weights.get(k, 0.0)) / total).otherwise(1.0 / count)
    mean = sum((F.when(there[k], weight(k) * F.col(f"n_{k}")).otherwise(0.0) for k in WEIGHTS), F.lit(0.0))
    density = (mean + boost * F.col("frequency")) / (1 + boost)
    return out.select(
        *[c for c in survivors.columns if c not in MEASURED],
        F.when(F.col("kind").isin(*PROTECTED_KINDS), 1.0).otherwise(F.round(density, 6)).alias("density"),
        F.create_map(
            *[x for k in WEIGHTS for x in (F.lit(k), F.round(f"n_{k}", 4))], F.lit("frequency"), F.round("frequency", 4)
        ).alias("density_parts"),
    )


def score_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("doc_id").agg(F.min("density").alias("least"), F.median("density").alias("median"), F.max("density").alias("most"))


def ranked(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("density"), "ord")))


def grep_rank(chunks: DataFrame, needle: str) -> DataFrame:
    """Rank and percentile of the chunks that hold ``needle``."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    found = ranked(chunks).withColumn("percentile", 100 * (1 - F.col("rank") / n))
    return found.where(F.contains("text", F.lit(needle)))
