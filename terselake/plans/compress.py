"""The whole compression of a table of documents: chunk, deduplicate, score, select, rebuild."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import dedup as D
from ..operators import density as N
from ..operators import embed as E
from ..operators import evaluate as V
from ..operators import rebuild as R
from ..operators import select as K
from ..operators.rewrite import rewrite
from ..scratch import drop, materialise, written
from ..sources.config import Config
from ..sources.ingest import with_protected

#: Shares of its tokens to which the comparison of strategies compresses a document.
RATIOS = (0.15, 0.30, 0.50)
STAGES = ("chunking", "redundancy", "density", "selection", "abstractive", "reconstruction")


KEY = ["doc_id", "id"]
#: Columns of a chunk that no stage reads; they stay with its text.
CARRIED = ["source", "level", "lines", "section", "heading_level", "language", "merged_parts", "split_part", "split_of", "forward_anchor", "fallback"]


@dataclass
class Compression:
    """Lazy tables of one run, each keyed by doc_id, and the folders of the stages they read.

    The chunks' texts are written once. ``fates`` and ``chosen`` are all chunks and the survivors without them, and
    every figure comes from these; ``chunks``, ``survivors`` and ``texts`` meet the texts when they are read.
    """

    documents: DataFrame
    originals: DataFrame
    fates: DataFrame
    clusters: DataFrame
    chosen: DataFrame
    markers: DataFrame | None
    bodies: DataFrame
    parts: DataFrame
    note: str | None = None
    paths: list[str] = field(default_factory=list)

    @property
    def chunks(self) -> DataFrame:
        return self.fates.join(self.bodies, KEY)

    @property
    def survivors(self) -> DataFrame:
        return self.chosen.join(self.parts, KEY).join(self.bodies, KEY)

    @property
    def texts(self) -> DataFrame:
        return R.stitch(self.chosen.where("selected").join(self.bodies, KEY), self.markers)

    @property
    def sizes(self) -> DataFrame:
        """(doc_id, compressed_tokens) of ``texts``."""
        return R.sizes(self.chosen, self.markers)

    def release(self) -> None:
        """Removes the stages' tables; what is lazy here can't be read any more."""
        drop(self.documents.sparkSession, self.paths)

    def rebuild_metrics(self) -> DataFrame:
        return R.rebuild_metrics(self.sizes, self.markers)

    def summary(self) -> DataFrame:
        """Tokens before and after, the ratio saved, and what was kept, per document; an empty one has zeros."""
        kept = self.chosen.groupBy("doc_id").agg(F.count_if("selected").alias("kept"), F.count_if(~F.col("selected")).alias("dropped"))
        absorbed = self.fates.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("leader").isNotNull()).alias("absorbed"))
        base = self.originals.withColumn("original_tokens", F.coalesce("original_tokens", F.lit(0)))
        rows = base.join(self.sizes, "doc_id", "left").join(kept, "doc_id", "left").join(absorbed, "doc_id", "left")
        rows = rows.fillna(0, ["compressed_tokens", "kept", "dropped", "chunks", "absorbed"])
        saved = F.when(F.col("original_tokens") > 0, 1 - F.col("compressed_tokens") / F.col("original_tokens")).otherwise(0.0)
        return rows.withColumn("compression_ratio", F.round(saved, 4))

    def stage_metrics(self) -> DataFrame:
        """Six rows a document, in the order of STAGES; all ``skipped`` where there was nothing to do."""
        chunks = self.fates.groupBy("doc_id").agg(F.sum("token_count").alias("c"), F.sum(F.when(F.col("leader").isNull(), F.col("token_count"))).alias("s"))
        kept = self.chosen.groupBy("doc_id").agg(F.sum(F.when(F.col("selected"), F.col("token_count")).otherwise(0)).alias("k"))
        rows = self.originals.select("doc_id").join(chunks, "doc_id", "left").join(kept, "doc_id", "left").join(self.sizes.withColumnRenamed("compressed_tokens", "t"), "doc_id", "left")
        into = {"chunking": ("c", "c"), "redundancy": ("c", "s"), "density": ("s", "s"), "selection": ("s", "k"), "abstractive": ("k", "k"), "reconstruction": ("k", "t")}
        one = lambda i, s: F.struct(F.lit(i).alias("no"), F.lit(s).alias("stage"), F.col(into[s][0]).alias("tokens_in"), F.col(into[s][1]).alias("tokens_out"))
        out = rows.select("doc_id", F.inline(F.array(*[one(i, s) for i, s in enumerate(STAGES)])))
        status = F.when(F.col("tokens_in").isNull() | (F.col("stage") == "abstractive") & F.lit(self.note is not None), "skipped").otherwise("ok")
        return out.withColumns({"status": status, "tokens_removed": F.coalesce(F.col("tokens_in") - F.col("tokens_out"), F.lit(0))})

    def payload(self, with_text: bool = True) -> DataFrame:
        """(doc_id, payload): summary, spans and markers as JSON; markers without the ids of their chunks."""
        spans = R.spans(self.chosen).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "kept", "kind", "tokens", "reason"))).alias("spans"))
        out = self.summary().join(spans, "doc_id", "left")
        if self.markers is not None:
            rows = R.recoverable(self.markers).drop("chunk_ids")
            out = out.join(rows.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("markers")), "doc_id", "left")
        if with_text:
            out = out.join(self.texts.select("doc_id", "compressed"), "doc_id", "left")
        return out.select("doc_id", F.to_json(F.struct(*[c for c in out.columns if c != "doc_id"])).alias("payload"))


def scored_chunks(
    docs: DataFrame, config: Config, *, query: str | DataFrame | None = None, instruction: str | None = None, embedder: E.Embedder | E.Chain | None = None,
    provider: str | None = None, kind: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(texts of the chunks, all chunks with their fate in deduplication, clusters, survivors with their density).

    Whatever follows from a text alone is found while the text is written, so it is in no later stage.
    """
    d = config.dedup
    rows = C.chunk(docs, kind, config.chunking)
    put = with_protected(rows, query, instruction)
    together = put is rows and embedder is None
    similar = None
    if embedder is not None:
        put = materialise(E.embed(materialise(put, "chunks"), embedder), "embedded")
        similar = D.threshold(provider, d.thresholds, d.similarity)[0]
    put = N.measured(K.named(D.keyed(put)), together=together, exact=d.exact, structural=d.structural, min_shape_tokens=d.min_shape_tokens)
    put = materialise(put, "measured", "zstd")
    away = ["text", *CARRIED, *(["template"] if embedder is None else [])]
    bodies = put.select(*KEY, *away)
    # All windows of a document find its rows in one place.
    fates = D.deduplicate(put.drop(*away).repartition("doc_id"), exact=d.exact, structural=d.structural, similar=similar, min_shape_tokens=d.min_shape_tokens)
    fates = materialise(fates, "deduplicated")
    groups = materialise(D.clusters(fates), "clusters")
    live = fates.where("leader is null").drop("leader", "method", "similarity", "root", "dedup_key", "signature", "label")
    mine = groups.select("doc_id", F.col("representative_id").alias("id"), "cluster_id", "absorbed_tokens", "method")
    # Only those that absorbed others have a cluster to meet.
    live = live.where("duplicate_count > 1").join(mine, KEY, "left").unionByName(live.where("duplicate_count = 1"), allowMissingColumns=True)
    if not together:
        live = materialise(live.join(bodies, KEY), "survivors")
        scored = N.score(live, weights=config.density.weights, boost=config.density.frequency_boost).drop(*away)
    else:
        scored = N.score(live, weights=config.density.weights, boost=config.density.frequency_boost)
    return bodies, fates, groups, materialise(scored, "scored")


def choose(scored: DataFrame, originals: DataFrame, config: Config) -> DataFrame:
    s = config.selection
    if s.repair and s.strategy == "density":
        return K.select_with_repair(scored, originals, ratio=s.ratio, least=s.min_kept, reserve=s.reserve, markers=config.reconstruction.drop_markers)
    return K.select(scored, originals, ratio=s.ratio, strategy=s.strategy, least=s.min_kept if s.strategy == "density" else 0)


def marks_of(chosen: DataFrame, groups: DataFrame, config: Config) -> DataFrame | None:
    r = config.reconstruction
    if not (r.drop_markers or r.cluster_markers):
        return None
    return R.markers(chosen, groups, drops=r.drop_markers, collapses=r.cluster_markers)


def compress(
    docs: DataFrame, *, config: Config | None = None, query: str | DataFrame | None = None, instruction: str | None = None,
    embedder: E.Embedder | E.Chain | None = None, provider: str | None = None, generate=None, kind: str | None = None,
) -> Compression:
    """Compresses ``docs`` (doc_id, name, text), each to its share of tokens; doc_id must be unique.

    Stages are written between one another, since each is read several times by the next; ``Compression.release``
    removes them. ``query`` is a question for all documents or a table (doc_id, query) with each one's own.
    Without an embedder, similarity, novelty and query relevance are left out and their weights pass to the
    other signals; without ``generate`` nothing is rewritten.
    """
    config = config or Config()
    docs = docs.select("doc_id", "name", "text")
    with written() as paths:
        originals = materialise(docs.select("doc_id", "name", T.token_count("text").alias("original_tokens")), "originals")
        bodies, fates, groups, scored = scored_chunks(docs, config, query=query, instruction=instruction, embedder=embedder, provider=provider, kind=kind)
        w = config.rewrite
        chosen = materialise(choose(scored.drop("density_parts"), originals.drop("name"), config), "selected")
        rewritten, _, why = rewrite(
            chosen.join(bodies, KEY), generate, enabled=w.enabled, stage_seconds=w.stage_seconds, least=w.min_tokens, limit=w.max_chunks, overlap=w.overlap, numbers=w.numbers
        )
        new = rewritten.select(*KEY, "compressed_text")
        chosen = chosen.withColumn("compressed_text", F.lit(None).cast("string")) if why else chosen.join(new, KEY)
        marks = marks_of(chosen, groups, config)
    return Compression(docs, originals, fates, groups, chosen, marks, bodies, scored.select(*KEY, "density_parts"), why, paths)


def compress_items(items: DataFrame, contexts: DataFrame, **options) -> tuple[DataFrame, Compression]:
    """(items with doc_id, compression): one compression for each different (context, question), shared by the items that ask it.

    ``items`` have context and question, ``contexts`` (context, text) and perhaps name. Each compression is aware of its question.
    """
    pairs = items.select("context", "question").distinct()
    # The number of a pair follows from the pair, so it is the same whenever the plan runs.
    pairs = pairs.withColumn("doc_id", F.xxhash64("context", "question"))
    texts = contexts if "name" in contexts.columns else contexts.withColumn("name", F.col("context"))
    docs = pairs.join(texts.select("context", "name", "text"), "context").select("doc_id", "name", "text")
    run = compress(docs, query=pairs.select("doc_id", F.col("question").alias("query")), **options)
    return items.withColumn("doc_id", F.xxhash64("context", "question")), run


def compare_strategies(
    items: DataFrame, contexts: DataFrame, *, ratios: tuple[float, ...] = RATIOS, strategies: tuple[str, ...] = ("truncate", "random", "density"),
    config: Config | None = None, **options,
) -> DataFrame:
    """(strategy, ratio, context, present, facts, survival, tokens): facts of ``items`` (context, key_facts) that survive in
    ``contexts`` (context, name, text), for each way to select and budget, by context and over all (context null).

    Chunks, duplicates and scores are the same for all, so they are made once; only selection and rebuilding differ.
    """
    config = config or Config()
    docs = contexts.select(F.xxhash64("context").alias("doc_id"), "context", "name", "text")
    originals = docs.select("doc_id", T.token_count("text").alias("original_tokens"))
    bodies, _, groups, scored = scored_chunks(docs.drop("context"), config, **options)
    out = None
    for ratio in ratios:
        for strategy in strategies:
            mine = config.with_overrides({"selection": {"ratio": ratio, "strategy": strategy}})
            chosen = choose(scored, originals, mine)
            texts = materialise(docs.select("doc_id", "context").join(R.stitch(chosen.where("selected").join(bodies, KEY), marks_of(chosen, groups, mine)), "doc_id"), "texts")
            sizes = texts.rollup("context").agg(F.sum("compressed_tokens").alias("tokens"))
            found = V.fact_survival(items, texts.select("context", F.col("compressed").alias("text")))
            sizes = sizes.withColumnRenamed("context", "_c")
            found = found.join(sizes, F.col("context").eqNullSafe(F.col("_c")), "left").drop("_c")
            rows = found.select(F.lit(strategy).alias("strategy"), F.lit(ratio).alias("ratio"), *found.columns)
            out = rows if out is None else out.unionByName(rows)
    return out
