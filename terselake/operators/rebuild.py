"""The shorter text: kept chunks in order, with markers for what was dropped or collapsed.

Runs of dropped chunks are islands of a window; markers and chunks are put in one order and joined by
separators that depend on their neighbours.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import CODE_KINDS

SHOWN = 4
NAME = 40
_WORD = re.compile(r"\w+|[^\w\s]")


def drop_runs(chunks: DataFrame) -> DataFrame:
    """A row per run of neighbouring chunks that aren't selected, in document order."""
    order = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = chunks.withColumn("run", F.sum(F.col("selected").cast("int")).over(order)).where("not selected")
    symbol = F.when(F.col("kind").isin(*CODE_KINDS) & (F.length("symbol") > 0) & (F.length("symbol") <= NAME), F.struct("ord", "symbol"))
    return marked.groupBy("doc_id", "run").agg(
        F.count("*").alias("sections"),
        F.sum("token_count").alias("tokens"),
        F.min("ord").alias("ord"),
        F.min_by("start_line", "ord").alias("start_line"),
        F.max_by("end_line", "ord").alias("end_line"),
        F.min("start_char").alias("start_char"),
        F.max("end_char").alias("end_char"),
        F.transform(F.sort_array(F.collect_list(symbol)), lambda x: x["symbol"]).alias("symbols"),
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("chunk_ids"),
    )


def drop_marker(marker_id: Column) -> Column:
    shown = F.array_join(F.slice("symbols", 1, SHOWN), ", ")
    more = F.when(F.size("symbols") > SHOWN, F.format_string(", +%d more", F.size("symbols") - SHOWN)).otherwise("")
    names = F.when(F.size("symbols") > 0, F.concat(F.lit(": "), shown, more)).otherwise("")
    head = F.format_string("[... omitted #%s %d section(s), %d tokens, lines %d-%d", marker_id, "sections", "tokens", "start_line", "end_line")
    return F.concat(head, names, F.lit(" ...]"))


def cluster_marker() -> Column:
    return F.format_string("[x%d #c%d near-identical occurrences collapsed (%d tokens saved, %s match)]", "size", "cluster_id", "absorbed_tokens", "method")


def markers(chunks: DataFrame, clusters: DataFrame | None = None, *, drops: bool = True, collapses: bool = True) -> DataFrame:
    """doc_id, marker_id, kind, ord, place, text and what is needed to recover: one row per marker.

    A dropped run's id counts the markers before it, of both kinds; a cluster's comes from the cluster.
    """
    parts = []
    base = "doc_id", "kind", "ord", "place", "sections", "tokens", "start_line", "end_line", "start_char", "end_char", "symbols", "chunk_ids"
    none = lambda t: F.lit(None).cast(t)
    if drops:
        runs = drop_runs(chunks).withColumns({"kind": F.lit("dropped"), "place": F.lit(0)})
        parts.append(runs.select(*base, none("int").alias("cluster_id"), none("string").alias("representative_id"), none("string").alias("method"), none("int").alias("size"), none("bigint").alias("absorbed_tokens")))
    if collapses and clusters is not None:
        lead = chunks.where("selected").select("doc_id", F.col("id").alias("representative_id"), "ord", "start_line", "end_line", "start_char", "end_char")
        found = clusters.join(lead, ["doc_id", "representative_id"]).withColumns(
            {
                "kind": F.lit("collapsed"), "place": F.lit(2), "sections": F.col("size").cast("bigint"), "tokens": F.col("absorbed_tokens").cast("bigint"),
                "symbols": F.array().cast("array<string>"), "chunk_ids": F.col("member_ids"),
            }
        )
        parts.append(found.select(*base, F.col("cluster_id").cast("int").alias("cluster_id"), "representative_id", "method", F.col("size").cast("int").alias("size"), F.col("absorbed_tokens").cast("bigint").alias("absorbed_tokens")))
    if not parts:
        raise ValueError("no markers asked for")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    before = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "place")) - 1
    named = both.withColumn("marker_id", F.when(F.col("kind") == "dropped", F.concat(F.lit("d"), before.cast("string"))).otherwise(F.concat(F.lit("c"), F.col("cluster_id").cast("string"))))
    text = F.when(F.col("kind") == "dropped", drop_marker(F.col("marker_id"))).otherwise(cluster_marker())
    return named.withColumn("text", text)


def body() -> Column:
    return F.regexp_replace("text", r"(?U)\s+$", "")


def parts(chunks: DataFrame, marks: DataFrame | None = None, text: bool = True) -> DataFrame:
    """(doc_id, ord, place, tight, words, text) of what the shorter text is made of; ``text`` only if asked for.

    Chunks that bring ``body_words``, the words of their text without the white space at its end, need no text for the rest.
    """
    kept = chunks.where("selected")
    if "compressed_text" in chunks.columns:
        again = F.regexp_replace("compressed_text", r"(?U)\s+$", "")
        whole = F.coalesce(again, body()) if "text" in chunks.columns else again
        words = F.coalesce(T.word_count(again), F.col("body_words") if "body_words" in chunks.columns else T.word_count(body()))
    else:
        whole, words = body() if text else None, F.col("body_words") if "body_words" in chunks.columns else T.word_count(body())
    mine = kept.select("doc_id", "ord", F.lit(1).alias("place"), (F.col("kind") == "log_record").alias("tight"), words.alias("words"), *([whole.alias("text")] if text else []))
    if marks is None:
        return mine
    return mine.unionByName(marks.select("doc_id", "ord", "place", F.lit(True).alias("tight"), T.word_count("text").alias("words"), *(["text"] if text else [])))


def _tokens() -> Column:
    """Tokens of the parts as one text: what stands between them is white space, so their words add up. Only a single
    part without words, or none, makes an empty text."""
    place = F.struct("ord", "place")
    some = F.coalesce(F.max(F.col("words") > 0), F.lit(False)) | F.coalesce(F.max(F.when(F.col("words").isNotNull(), place)) > F.min(place), F.lit(False))
    return F.when(some, T.tokens_of(F.coalesce(F.sum("words"), F.lit(0)))).otherwise(0).alias("compressed_tokens")


def sizes(chunks: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(doc_id, compressed_tokens) of the text that :func:`stitch` makes, which isn't made for it."""
    return parts(chunks, marks, text=False).groupBy("doc_id").agg(_tokens())


def stitch(chunks: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(doc_id, compressed, compressed_tokens): a line feed between log records and markers, a blank line elsewhere."""
    order = Window.partitionBy("doc_id").orderBy("ord", "place")
    before = F.lag("tight").over(order)
    gap = F.when(before.isNull(), "").when(before & F.col("tight"), "\n").otherwise("\n\n")
    return parts(chunks, marks).withColumn("gap", gap).groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "place", "gap", "text"))), lambda x: F.concat(x["gap"], x["text"])), "").alias("compressed"),
        _tokens(),
    )


def digests(chunks: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """(doc_id, compressed, compressed_tokens) as :func:`stitch`, with the MD5 of the text in its place.

    The parts of a document pass in order through one hash, so a text of any size is never held.
    """
    rows = parts(chunks, marks)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, tight, digest = none, False, None
        ids, found = [], []
        for b in batches:
            bodies = b.column(2).cast(pa.large_binary())
            for k, (key, close) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                first = now is none or key != now
                if first:
                    if now is not none:
                        ids.append(now)
                        found.append(digest.hexdigest())
                    now, digest = key, hashlib.md5(usedforsecurity=False)
                one = bodies[k].as_py()
                if one is not None:
                    digest.update((b"" if first else b"\n" if tight and close else b"\n\n") + one)
                tight = close
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(found, pa.string())], ["doc_id", "compressed"])
                ids, found = [], []
        if now is not none:
            yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field(0).type), pa.array([digest.hexdigest()], pa.string())], ["doc_id", "compressed"])

    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord", "place").select("doc_id", "tight", "text")
    hashed = ordered.mapInArrow(run, f"doc_id {kind}, compressed string")
    tokens = sizes(chunks, marks).withColumnRenamed("doc_id", "_d")
    return hashed.join(tokens, F.col("doc_id").eqNullSafe(F.col("_d"))).select("doc_id", "compressed", "compressed_tokens")


def rebuild_metrics(texts: DataFrame, marks: DataFrame | None) -> DataFrame:
    """(doc_id, tokens_out, markers, marker_tokens, content_tokens): how much of each text is markers."""
    if marks is None:
        per = texts.select("doc_id", F.lit(0).cast("long").alias("markers"), F.lit(0).cast("long").alias("marker_tokens"))
    else:
        per = marks.groupBy("doc_id").agg(F.count("*").alias("markers"), F.sum(T.token_count("text")).alias("marker_tokens"))
    out = texts.join(per, "doc_id", "left").fillna(0, ["markers", "marker_tokens"])
    return out.select("doc_id", F.col("compressed_tokens").alias("tokens_out"), "markers", "marker_tokens", (F.col("compressed_tokens") - F.col("marker_tokens")).alias("content_tokens"))


def recoverable(marks: DataFrame) -> DataFrame:
    return marks.select("doc_id", "marker_id", "kind", "chunk_ids", "sections", "tokens", "start_line", "end_line", "start_char", "end_char", "representative_id", "method")


def expand(marks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, marker_id, text, chunks): what each marker stands for, its chunks' texts in order."""
    ids = marks.select("doc_id", "marker_id", F.posexplode("chunk_ids").alias("k", "id"))
    rows = ids.join(chunks.select("doc_id", "id", "text", "ord"), ["doc_id", "id"])
    return rows.groupBy("doc_id", "marker_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("chunks")
    )


def spans(chunks: DataFrame) -> DataFrame:
    """Bands of neighbouring chunks with one fate and file; injected chunks are left out."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    source = F.coalesce(F.col("source_file") if "source_file" in chunks.columns else F.lit(None).cast("string"), F.lit(""))
    real = chunks.where("start_char >= 0").withColumn("_file", source)
    new = (F.lag("selected").over(order) != F.col("selected")) | (F.lag("_file").over(order) != F.col("_file"))
    banded = real.withColumn("band", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.count("*") == 1
    first = lambda c: F.min_by(c, "ord")
    return banded.groupBy("doc_id", "band").agg(
        F.min("start_char").alias("start_char"),
        F.max("end_char").alias("end_char"),
        F.min("start_line").alias("start_line"),
        F.max("end_line").alias("end_line"),
        first("selected").alias("kept"),
        F.nullif(first("_file"), F.lit("")).alias("source_file"),
        F.when(F.count_distinct("kind") == 1, F.min("kind")).otherwise("mixed").alias("kind"),
        F.sum("token_count").alias("tokens"),
        F.count("*").alias("chunks"),
        F.when(alone, first("symbol")).alias("symbol"),
        F.when(alone, first("density")).alias("density"),
        first("drop_reason").alias("reason"),
        first("duplicate_count").alias("duplicate_count"),
    )


def measure(rows: list[dict], kept: set[str], marks: bool = True) -> int:
    """Tokens of the text that :func:`stitch` and :func:`markers` make of these rows (with their ``words``); words add up over parts."""
    words = 0
    run: list[dict] = []

    def close() -> int:
        if not run or not marks:
            return 0
        names = [r["symbol"] for r in run if r["symbol"] and r["kind"] in CODE_KINDS and len(r["symbol"]) <= NAME]
        more = f", +{len(names) - SHOWN} more" if len(names) > SHOWN else ""
        tail = f": {', '.join(names[:SHOWN])}{more}" if names else ""
        text = f"[... omitted #d0 {len(run)} section(s), {sum(r['token_count'] for r in run)} tokens, lines {run[0]['start_line']}-{run[-1]['end_line']}{tail} ...]"
        return len(_WORD.findall(text))

    for r in rows:
        if r["id"] not in kept:
            run.append(r)
            continue
        words += close() + r["words"]
        run = []
        if marks and r["duplicate_count"] and r["duplicate_count"] > 1 and r["method"]:
            text = f"[x{r['duplicate_count']} #c0 near-identical occurrences collapsed ({int(r['absorbed_tokens'] or 0)} tokens saved, {r['method']} match)]"
            words += len(_WORD.findall(text))
    words += close()
    return max(1, round(words * 1.3)) if words else 0
