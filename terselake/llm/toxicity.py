"""Toxicity by two class-conditional Kneser-Ney models over the characters of words.

A word is read as ``^word$``; each character is predicted from the up to ``ORDER - 1`` before it. The top
order has counts of its own for toxic and for ordinary training documents. All lower orders are one shared
Kneser-Ney model of continuation counts over every document, labelled or not, so a rare or inflected
expression borrows from its parts, alike in both classes. What the classes share cancels in the log ratio:
a gram that neither class has seen is worth the ratio of the two backoff weights of its context.

Distinct words are counted in each task and by a shuffle of words, their characters then by a shuffle of grams
(never of tokens). The model that scores holds every gram that a class has seen and every context of one, by
its characters, and grows with the distinct grams: 32 bytes each in every Python worker.

A document's features are its log ratio per word, over the whole text and over its best window of each
length in ``WINDOWS``, so an expression of several words counts as one, and how many words stand above each of
``MARKED``. A logistic fit on at most ``fit_rows`` labelled rows, none of which is in the class counts, turns
them into a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small

ORDER = 6
WINDOWS = (1, 3, 8, 32)
#: Bytes of text that are split at once, and words that a task counts before it hands them on.
STRETCH = 2 << 20
HELD = 250_000
MARKED = (2.0, 4.0)
FEATURES = [f"best_{w}" for w in WINDOWS] + ["top_3", "whole"] + [f"above_{t:g}" for t in MARKED]


def words(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each stretch of texts: its distinct words between ``^`` and ``$``, the number of each text's words
    among them, one after another, and where each text begins and the last ends. A token without letters or digits is empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edge = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // STRETCH
    cuts = [0, *(np.flatnonzero(np.diff(edge)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        found = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts[a:b])))
        split = found.flatten().dictionary_encode()
        bare = pc.replace_substring_regex(split.dictionary, r"^[^\pL\pN_]+|[^\pL\pN_]+$", "")
        open_, close, none = (pa.scalar(c, pa.large_string()) for c in ("^", "$", ""))
        word = pc.if_else(pc.equal(bare, none), none, pc.binary_join_element_wise(open_, bare, close, none))
        yield word, split.indices.to_numpy(), found.offsets.to_numpy() - found.offsets[0].as_py()


def grams(word: str) -> list[str]:
    """The characters of a word between ``^`` and ``$``, each with its context before it."""
    return [word[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(word))]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "ordinary", "toxic"]
    seen: set[str] = set()
    sums = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        found = list(seen)
        cols = [pa.array(found, pa.string())] + [pa.array([c[w] for w in found], pa.int64()) for c in sums]
        for held in (seen, *sums):
            held.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    for b in batches:
        kinds, at = b.column(1).to_numpy(), 0
        for word, number, cut in words(b.column(0)):
            kind = np.repeat(kinds[at : at + len(cut) - 1], np.diff(cut))
            at += len(cut) - 1
            listed = word.to_pylist()
            seen.update(listed)
            for k, c in enumerate(sums, 1):
                n = np.bincount(number[kind == k], minlength=len(listed))
                for w in np.flatnonzero(n).tolist():
                    c[listed[w]] += int(n[w])
            if len(seen) > HELD:
                yield flush()
    yield flush()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        cols = [pa.array(list(found), pa.string())] + [pa.array([c[k] for c in found.values()], pa.int64()) for k in (0, 1)]
        found.clear()
        return pa.RecordBatch.from_arrays(cols, ["gram", "ordinary", "toxic"])

    for b in batches:
        for word, ordinary, toxic in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for g in grams(word):
                c = found.setdefault(g, [0, 0])
                c[0] += ordinary
                c[1] += toxic
            if len(found) > HELD:
                yield flush()
    yield flush()


def gram_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text, kind 0 other, 1 ordinary, 2 toxic) to (gram, ordinary, toxic)."""
    sums = [F.sum(c).alias(c) for c in ("ordinary", "toxic")]
    counted = docs.select(F.col("text").cast("string"), F.col("kind").cast("int")).mapInArrow(_count_words, "word string, ordinary long, toxic long")
    counted = counted.groupBy("word").agg(*sums)
    return counted.mapInArrow(_count_grams, "gram string, ordinary long, toxic long").groupBy("gram").agg(*sums)


def _head(c: Column) -> Column:
    return F.substring(c, 1, F.length(c) - 1)


def _tail(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c))


def shared_model(counts: DataFrame, discount: float = 0.75) -> DataFrame:
    """(gram, p): Kneser-Ney probability of each gram below the top order, from continuation counts."""
    size = F.length("gram")
    model = None
    level = {ORDER: counts.where(size == ORDER).select("gram")}
    for n in range(ORDER - 1, 0, -1):  # the distinct grams of each length, and how many characters come before each
        own = counts.where((size == n)).select("gram")
        after = level[n + 1].select(_tail(F.col("gram")).alias("gram"))
        level[n] = materialise(
            after.groupBy("gram").agg(F.count("*").alias("n")).unionByName(own.select("gram", F.lit(0).cast("long").alias("n"))).groupBy("gram").agg(F.sum("n").alias("n")),
            "level",
        )
    alphabet = max(1, level[1].count())
    below = None
    for n in range(1, ORDER):
        now = level[n].where("n > 0").withColumn("context", _head(F.col("gram")))
        total = now.groupBy("context").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        now = now.join(total, "context")
        if below is None:
            now = now.withColumn("lower", F.lit(1.0 / alphabet))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            now = now.withColumn("suffix", _tail(F.col("gram"))).join(lower, "suffix", "left").fillna({"lower": 1.0 / alphabet})
        p = (F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("lower")) / F.col("all")
        below = materialise(now.select("gram", p.alias("p")), "lower")
        model = below if model is None else model.unionByName(below)
    return model


def ratios(counts: DataFrame, discount: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) of grams that a class has seen, and (gram, ratio) of contexts for those it hasn't."""
    lower = shared_model(counts, discount).select(F.col("gram").alias("suffix"), F.col("p").alias("shared"))
    top = counts.where("ordinary + toxic > 0").withColumn("context", _head(F.col("gram")))
    sums = [
        f(k) for k in ("ordinary", "toxic") for f in (lambda k: F.sum(k).alias(f"{k}_all"), lambda k: F.count_if(F.col(k) > 0).alias(f"{k}_kinds"))
    ]
    context = materialise(top.groupBy("context").agg(*sums), "contexts")
    weight = lambda k: F.when(F.col(f"{k}_all") > 0, discount * F.col(f"{k}_kinds") / F.col(f"{k}_all")).otherwise(1.0)
    seen = top.join(context, "context").withColumn("suffix", _tail(F.col("gram"))).join(lower, "suffix", "left").fillna({"shared": 1e-6})
    p = lambda k: F.when(
        F.col(f"{k}_all") > 0, F.greatest(F.col(k) - discount, F.lit(0.0)) / F.col(f"{k}_all")
    ).otherwise(0.0) + weight(k) * F.col("shared")
    one = seen.select("gram", (F.log(p("toxic")) - F.log(p("ordinary"))).alias("ratio"))
    two = context.select(F.col("context").alias("gram"), (F.log(weight("toxic")) - F.log(weight("ordinary"))).alias("ratio"))
    return one, two


def _codes(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all strings, one after another, plus 1, and the length of each."""
    whole = "".join(found.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(whole, "<u4").astype(np.uint64) + np.uint64(1), pc.utf8_length(found).to_numpy(zero_copy_only=False).astype(np.int64)


def _keys(code: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` characters up to ``last`` as two numbers of three each, so that no two grams are alike."""
    out = []
    for first in (3, 0):
        key = np.zeros(len(last), np.uint64)
        for k in range(first, first + 3):
            key |= np.where(size > k, code[np.maximum(last - k, 0)], np.uint64(0)) << np.uint64(21 * (k - first))
        out.append(key)
    return out[0], out[1]


class Table:
    """Log ratios of grams, sorted by a hash that no two of them share."""

    def __init__(self, high: np.ndarray, low: np.ndarray, value: np.ndarray):
        self.seed = 0
        while len(np.unique(h := self._hash(high, low))) < len(h):
            self.seed += 1
        order = np.argsort(h)
        self.high, self.low, self.value = high[order], low[order], value[order]
        self.hash = h[order]

    def _hash(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        h = (high + np.uint64(self.seed)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(32) ^ low) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    def get(self, code: np.ndarray, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which grams the table holds, and their log ratios, 0 for others."""
        if not len(self.hash):
            return np.zeros(len(last), bool), np.zeros(len(last))
        high, low = _keys(code, last, size)
        at = np.minimum(np.searchsorted(self.hash, self._hash(high, low)), len(self.hash) - 1)
        hit = (self.high[at] == high) & (self.low[at] == low)
        return hit, np.where(hit, self.value[at], 0.0)


def table(ratio: DataFrame) -> Table:
    """All rows (gram, ratio); they reach the driver, one a distinct gram."""
    high, low, value = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0)]
    for b in ratio.select("gram", F.col("ratio").cast("double")).toArrow().to_batches(100_000):
        code, size = _codes(b.column(0))
        for part, x in zip((high, low, value), (*_keys(code, np.cumsum(size) - 1, size), b.column(1).to_numpy()), strict=True):
            part.append(x)
    return Table(*map(np.concatenate, (high, low, value)))


def word_ratios(word: pa.Array, seen: Table, context: Table) -> np.ndarray:
    """The log ratio of each word: that of its grams, or for one that no class has seen, that of its context."""
    code, size = _codes(word)
    owner = np.repeat(np.arange(len(word)), size)
    before = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)  # characters before it in its word
    last = np.flatnonzero(before)
    hit, value = seen.get(code, last, np.minimum(before[last] + 1, ORDER))
    missed = np.flatnonzero(~hit)
    value[missed] = context.get(code, last[missed] - 1, np.minimum(before[last[missed]], ORDER - 1))[1]
    return np.bincount(owner[last], value, len(word))


def features(v: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, whose words' ratios stand in ``v`` between neighbouring ``cut``; zeros if it has none."""
    size = np.diff(cut)
    out = np.zeros((len(size), len(FEATURES)))
    some = np.flatnonzero(size)
    if not len(some):
        return out
    start, n = cut[:-1][some], size[some]
    sums = np.concatenate(([0.0], np.cumsum(v)))
    total = sums[start + n] - sums[start]
    left = np.repeat(start + n, n) - np.arange(len(v))  # words from here to the text's end
    cols = []
    for w in WINDOWS:
        run = np.full(len(v), -np.inf)
        run[: max(0, len(v) - w + 1)] = sums[w:] - sums[:-w]
        best = np.maximum.reduceat(np.where(left >= w, run, -np.inf), start)
        cols.append(np.where(n >= w, best / w, total / n))
    high, owner, three = v.copy(), np.repeat(np.arange(len(n)), n), np.zeros(len(n))
    for k in range(3):
        most = np.maximum.reduceat(high, start)
        three += np.where(n > k, most, 0.0)
        at = np.flatnonzero(high == most[owner])
        high[at[np.unique(owner[at], return_index=True)[1]]] = -np.inf
    cols += [three / 3, total / n]
    cols += [np.log1p(np.add.reduceat((v > t).astype(float), start)) for t in MARKED]
    out[some] = np.column_stack(cols)
    return out


def with_features(docs: DataFrame, seen: Table, context: Table, keep: list[str]) -> tuple[DataFrame, Broadcast]:
    """``keep`` columns as struct ``doc``, then the features of ``text``; and the broadcast model, to be released."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((seen, context))
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")
    inside = "text" in keep and dict(docs.dtypes)["text"] == "string"  # a text that is kept needn't come twice
    rows = docs.select(doc) if inside else docs.select(doc, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.zeros((0, len(FEATURES)))]
            for word, number, cut in words(pc.struct_field(b.column(0), "text") if inside else b.column(1)):
                found.append(features(word_ratios(word, *model.value)[number], cut))
            found = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[:, i]) for i in range(len(FEATURES))]], ["doc", *FEATURES])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "doc " + rows.schema["doc"].dataType.simpleString() + "".join(f", {f} double" for f in FEATURES)), model


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic fit by Newton's method; constant if a class is missing."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.1
        return np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.r_[np.full(x.shape[1], 1.0), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:-1] / sd
    return slope, float(w[-1] - slope @ mean)


def _remainder() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))


def score(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, fit_rows: int = 20_000) -> DataFrame:
    """Returns struct ``doc`` (``keep`` columns, default doc_id), ``held_out``, ``score`` and the features.

    Labels (doc_id, toxic) are read only of documents whose crc32(doc_id) mod 3 isn't 1; three quarters
    of them make the class counts, the rest the fit. Of several labels of a document the largest counts;
    null labels and labels of null doc_ids are left out. Null and empty texts have all-zero features and
    the score that follows. Repeated rows are scored alike. Without labels of both classes every
    score is their share. Columns other than doc_id and text play no part.
    """
    h = _remainder()
    told = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.where(F.pmod(h, F.lit(3)) != 1)
    fitted = F.pmod(F.floor(h / 3), F.lit(4)) == 0
    count = told.where(~fitted)
    kind = F.when(F.col("toxic") > 0, 2).when(F.col("toxic") == 0, 1).otherwise(0)
    # A null doc_id has no label; where texts are shuffled to their labels, such rows are dealt by their text.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)
    told_docs = docs.select("doc_id", "text", salt.alias("salt")).join(small(count.withColumn("salt", F.lit(0).cast("long"))), ["doc_id", "salt"], "left")
    counts = materialise(gram_counts(told_docs.select("text", kind.alias("kind"))), "grams")
    seen, context = (table(t) for t in ratios(counts))

    lazy, model = with_features(docs, seen, context, keep or ["doc_id"])
    found = materialise(lazy, "features")
    model.destroy()
    sample = told.where(fitted).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = found.select(F.col("doc.doc_id").alias("doc_id"), *FEATURES).join(F.broadcast(sample), "doc_id")
    # Of several texts with one doc_id, the greatest of each feature counts.
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), *[F.max(f).alias(f) for f in FEATURES]).orderBy("doc_id").toArrow()
    x = np.column_stack([rows.column(f).to_numpy() for f in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    slope, intercept = fit(x, (rows.column("toxic").to_numpy() > 0).astype(float) if rows.num_rows else np.zeros(0))
    z = F.lit(intercept)
    for f, s in zip(FEATURES, slope.tolist(), strict=True):
        z = z + F.col(f) * s
    out = found.withColumn("score", 1 / (1 + F.exp(-z)))
    held = F.pmod(F.coalesce(F.crc32(F.col("doc.doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(3)) == 1
    return out.select("doc", held.alias("held_out"), "score", *FEATURES)
