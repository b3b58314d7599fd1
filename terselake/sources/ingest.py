"""Files to documents: uploads with their limits, combination, provenance, samples, test sets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

# ---- fixed values ----
TEXT_SUFFIXES = (
    ".txt", ".md", ".markdown", ".rst", ".log", ".csv", ".tsv", ".py", ".js", ".ts", ".tsx", ".jsx", ".json", ".yaml", ".yml",
    ".toml", ".ini", ".cfg", ".sh", ".bash", ".zsh", ".sql", ".java", ".go", ".rs", ".c", ".h", ".cpp", ".hpp", ".cs", ".rb",
    ".php", ".swift", ".kt", ".css", ".scss", ".html", ".xml",
)
MAX_FILES, MAX_TOTAL_BYTES, MAX_FILE_BYTES, MAX_TEXT_CHARS = 10, 10_000_000, 5_000_000, 2_000_000
SNIFF = 8192
REPORT_COLUMNS = (
    "id", "context", "verdict", "orig_tokens", "comp_tokens", "token_reduction_pct", "orig_recall", "comp_recall",
    "facts_in_compressed_ctx", "orig_latency_ms", "comp_latency_ms", "speedup", "missing_facts_compressed", "question",
)
# ---- end of fixed values ----


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole files, bad bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(_base("path").alias("name"), decoded(F.col("content")).alias("text"))


def _base(c: str | Column) -> Column:
    return F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"([^/\\]*)$", 1)


def suffix(name: Column | str) -> Column:
    """From the last dot of the base name, lower case; empty if it has none."""
    return F.lower(F.regexp_extract(_base(name), r"^.+(\.[^.]+)$", 1))


def decoded(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def extract(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """files (pos, name, content binary) to status rows; a file that can't be used says why and never fails.

    A pdf's text needs a library that isn't part of this build, so pdfs are skipped with that reason.
    """
    kind = suffix("name")
    size = F.octet_length("content")
    text = F.regexp_replace(decoded(F.col("content")), r"(?U)^\s+|\s+$", "")
    zero = F.position(F.lit(b"\x00"), F.substring("content", 1, SNIFF)) > 0
    reason = (
        F.when(~kind.isin(*TEXT_SUFFIXES, ".pdf"), F.concat(F.lit("unsupported type "), kind))
        .when(F.col("content").isNull() | (size == 0), "empty file")
        .when(size > max_bytes, F.lit(f"larger than {max_bytes} bytes"))
        .when(kind == ".pdf", "no pdf reader is installed")
        .when(zero, "binary content")
        .when(text == "", "no text")
    )
    return files.select(
        "pos", _base("name").alias("name"), F.when(reason.isNull(), "done").otherwise("skipped").alias("status"), reason.alias("reason"),
        F.when(reason.isNull(), text).alias("text"), F.when(reason.isNull(), F.length(text)).otherwise(0).alias("characters"),
    )


def check_limits(files: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(problem) for uploads beyond the limits; no rows if all is well."""
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    found = total.select(F.explode(F.array_compact(F.array(
        F.when(F.col("n") > MAX_FILES, F.lit(f"more than {MAX_FILES} files")),
        F.when(F.col("bytes") > MAX_TOTAL_BYTES, F.lit(f"more than {MAX_TOTAL_BYTES} bytes")),
    ))).alias("problem"))
    if texts is None:
        return found
    return found.unionByName(texts.where(F.length("text") > MAX_TEXT_CHARS).select(F.lit(f"more than {MAX_TEXT_CHARS} characters").alias("problem")))


def source_files(files: DataFrame, group: str = "doc_id") -> DataFrame:
    """Adds start and end of each used file in its group's combined text, a blank line between files."""
    used = files.where("status = 'done'")
    before = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return used.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int")).withColumn(
        "end", (F.col("start") + F.length("text")).cast("int")
    )


def combine(files: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, name, text): used files in order, joined by a blank line, with a name that routes them."""
    used = files.where("status = 'done'")
    kinds = F.collect_set(suffix("name"))
    name = (
        F.when(F.count("*") == 1, F.min("name"))
        .when((F.size(kinds) == 1) & (F.get(kinds, 0) != ""), F.concat(F.lit("uploads"), F.get(kinds, 0)))
        .otherwise("uploads.txt")
    )
    return used.groupBy(group).agg(
        name.alias("name"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("text")
    )


def with_provenance(chunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds ``source_file``: the file whose range holds the chunk's start, else the document's name.

    An equi-join on doc_id with the range as its condition; a document has few files.
    """
    r = ranges.select(F.col("doc_id").alias("_d"), F.col("name").alias("_name"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = (F.col("doc_id") == F.col("_d")) & (F.col("_s") <= F.col("start_char")) & (F.col("start_char") < F.col("_e"))
    return chunks.join(r, inside, "left").withColumn("source_file", F.coalesce("_name", "source")).drop("_d", "_name", "_s", "_e")


def samples(spark: SparkSession, root: str) -> DataFrame:
    """(kind, name, text, tokens) of a folder of sample folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    rows = files.select(kind.alias("kind"), _base("path").alias("name"), decoded(F.col("content")).alias("text"))
    return rows.withColumn("tokens", T.token_count("text"))


def sample(spark: SparkSession, root: str, kind: str, name: str) -> DataFrame:
    """One sample; a kind or name that leads elsewhere is refused."""
    for part in (kind, name):
        if not part or part in (".", "..") or "/" in part or "\\" in part:
            raise ValueError(f"not a sample: {kind}/{name}")
    return read_texts(spark, f"{root.rstrip('/')}/{kind}/{name}")


def read_testset(spark: SparkSession, path: str, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts, items) of a JSON test set; ``texts`` (source, text) gives the contexts' files, cut to their lines."""
    schema = (
        "contexts map<string, struct<source: string, lines: array<int>, description: string>>, "
        "items array<struct<id: string, context: string, question: string, expected_answer: string, key_facts: array<string>>>"
    )
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    contexts = raw.select(F.explode("contexts").alias("context", "c")).select("context", "c.*").join(texts, "source")
    lines = F.split("text", "\n")
    cut = F.when(F.col("lines").isNotNull(), F.array_join(F.slice(lines, F.col("lines")[0] + 1, F.col("lines")[1] - F.col("lines")[0]), "\n")).otherwise(F.col("text"))
    items = raw.select(F.explode("items").alias("i")).select("i.*")
    # A fact is a string or a JSON list of alternatives; both become a list.
    facts = F.transform("key_facts", lambda f: F.coalesce(F.when(f.startswith("["), F.from_json(f, "array<string>")), F.array(f)))
    return contexts.withColumn("text", cut), items.withColumn("key_facts", facts)


def report_rows(items: DataFrame) -> DataFrame:
    """The columns of the CSV report from items with both arms."""
    return items.select(
        F.col("item_id").alias("id"), "context", "verdict", F.col("orig_tokens_in").alias("orig_tokens"), F.col("comp_tokens_in").alias("comp_tokens"),
        F.round(100 * (1 - F.col("comp_tokens_in") / F.col("orig_tokens_in")), 1).alias("token_reduction_pct"),
        F.round("orig_recall", 3).alias("orig_recall"), F.round("comp_recall", 3).alias("comp_recall"),
        F.col("facts_present").alias("facts_in_compressed_ctx"), F.round("orig_latency_ms", 1).alias("orig_latency_ms"),
        F.round("comp_latency_ms", 1).alias("comp_latency_ms"), F.round("speedup", 2).alias("speedup"),
        F.array_join("missing_facts", "|").alias("missing_facts_compressed"), "question",
    )


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    summary.write.mode("overwrite").json(f"{path}/json")


def synthetic_log(spark: SparkSession, records: int = 2400, seed: int = 7, window: tuple[int, int] = (900, 1200)) -> DataFrame:
    """(no, line): a service's log with routine records, rare ones, and an incident with stack traces."""
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(n))
    routine = (
        "cart %d priced in %d ms", "session usr_%d renewed", "cache hit for sku-%d after %d us", "payment ORD-%d authorised",
        "stock of item %d checked", "email queued for usr_%d", "request GET /v1/cart/%d served in %d ms",
    )
    rare = ("config reloaded from node %d", "certificate rotates in %d days", "replica %d promoted", "schema version %d applied", "quota at %d percent")
    fill = lambda p: F.format_string(p, *[(draw(i + 10, 90000) + 10000) for i in range(p.count("%d"))])
    pick = lambda ps, k: F.element_at(F.array(*[fill(p) for p in ps]), (draw(k, len(ps)) + 1).cast("int"))
    time = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3), "yyyy-MM-dd HH:mm:ss")
    bad = F.col("id").between(window[0], window[1] - 1) & (draw(1, 4) == 0)
    level = F.when(bad, "ERROR").when(draw(2, 97) == 0, "WARN").otherwise("INFO")
    message = F.when(bad, fill("connection pool exhausted after %d ms")).when(level == "WARN", pick(rare, 3)).otherwise(pick(routine, 4))
    trace = '\nTraceback (most recent call last):\n  File "pool.py", line 88, in take\n    raise PoolTimeout(waited)\nPoolTimeout: no connection left'
    tail = F.when(bad & (draw(5, 6) == 0), F.lit(trace)).otherwise("")
    return spark.range(records).select(F.col("id").alias("no"), F.concat(time, F.lit(" "), level, F.lit(" checkout [eu-west-1] "), message, tail).alias("line"))


def with_protected(chunks: DataFrame, query: str | DataFrame | None = None, instruction: str | None = None) -> DataFrame:
    """Puts an instruction and a query before each document's chunks, never to be dropped.

    ``query`` is one text for all, or a table (doc_id, query) with each document's own; an empty one isn't put.
    """
    one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), F.trim(text).alias("text"))
    docs = chunks.groupBy("doc_id").agg(F.first("source").alias("source"))
    asked = F.lit(query if isinstance(query, str) else None).cast("string")
    if isinstance(query, DataFrame):
        docs, asked = docs.join(query.select("doc_id", F.col("query").alias("_query")), "doc_id", "left"), F.col("_query")
    elif not (query or "").strip() and not (instruction or "").strip():
        return chunks
    both = F.array(one("instruction", F.lit(instruction).cast("string")), one("query", asked))
    docs = docs.select("doc_id", "source", F.filter(both, lambda t: F.coalesce(t["text"], F.lit("")) != "").alias("_put"))
    number = F.col("_k").cast("int")
    put = docs.select("doc_id", "source", F.posexplode("_put").alias("_k", "_t"))
    values = {
        "doc_id": F.col("doc_id"), "source": F.col("source"), "ord": number, "kind": F.col("_t.kind"), "text": F.col("_t.text"),
        "id": F.concat("_t.kind", F.lit("#"), F.format_string("%04d", number), F.lit(":"), "_t.kind"),
        "start_char": F.lit(-1), "end_char": F.lit(-1), "start_line": F.lit(0), "end_line": F.lit(0), "token_count": T.token_count(F.col("_t.text")),
    }
    put = put.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in chunks.dtypes])
    shifted = chunks.join(docs.select("doc_id", F.size("_put").alias("_n")), "doc_id").withColumn("ord", F.col("ord") + F.col("_n"))
    return shifted.select(*chunks.columns).unionByName(put)
