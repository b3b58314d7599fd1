"""Registered queries over the test tables, named by operator, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunk as C
from ..operators import dedup as D
from ..operators import density as N
from ..operators import embed as E
from ..operators import evaluate as V
from ..operators import rebuild as R
from ..operators import select as K
from ..session import ship
from ..sources import ingest as S
from .compress import Compression, compress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A task holds the row group that it reads. Read by ranges, a local file passes through a second buffer of that size.
BY_PIECES = {"parquet.hadoop.vectored.io.enabled": "false"}


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table; one in fewer files than there are cores is spread over them, as a file's row group is one task's work.

    A ``key`` is for tables of large rows: dealt by it, rows pass at once, where dealing them in turn sorts all of a task's.
    """
    read = ship(spark).read
    found = (read if key is None else read.options(**BY_PIECES)).parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found if len(found.inputFiles()) >= cores else found.repartition(cores, *([] if key is None else [key]))


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---- SQL pieces that several oracles share ----
WORDS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
TOKENS = "CASE WHEN {0} = '' THEN 0 ELSE greatest(1, CAST(round_even(" + WORDS + " * 1.3, 0) AS INT)) END"
SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return TOKENS.format(c)


def squeeze_sql(c: str) -> str:
    return SQUEEZE.format(c)


LINES_SQL = (
    "SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE event_type WHEN 'error' THEN ' ERROR' WHEN 'signup' THEN ' WARN' ELSE ' INFO' END || "
    "' api ' || event_type || ' user=' || user_id || ' order=ORD-' || (event_id + 10000) || ' from 10.0.0.' || (event_id % 250) || ' took ' || (event_id % 977) || 'ms' AS line FROM events"
)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a service's log."""
    level = F.when(F.col("event_type") == "error", " ERROR").when(F.col("event_type") == "signup", " WARN").otherwise(" INFO")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, F.lit(" api "), "event_type", F.lit(" user="), F.col("user_id").cast("string"),
        F.lit(" order=ORD-"), (F.col("event_id") + 10000).cast("string"), F.lit(" from 10.0.0."), (F.col("event_id") % 250).cast("string"),
        F.lit(" took "), (F.col("event_id") % 977).cast("string"), F.lit("ms"),
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", line.alias("line"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as chunks of their conversation."""
    t = table(spark, sf_dir, "conversations")
    none = {c: F.lit(None).cast(k) for c, k in (("symbol", "string"), ("template", "string"), ("level", "string"))}
    rows = t.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.col("turn").cast("string").alias("id"), F.lit("paragraph").alias("kind"), "role", "text")
    return rows.withColumns({"token_count": T.token_count("text"), **none})


def by_source(spark: SparkSession, sf_dir: str, group: str = "source", key: str | None = None) -> DataFrame:
    """Documents as chunks of their source, or of another group; ``key`` as in :func:`table`."""
    t = table(spark, sf_dir, "documents", key)
    none = {c: F.lit(None).cast(k) for c, k in (("symbol", "string"), ("template", "string"), ("level", "string"))}
    rows = t.select(F.col(group).alias("doc_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.lit("paragraph").alias("kind"), "text")
    return rows.withColumns({"token_count": T.token_count("text"), **none})


@query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def T1_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count("text").alias("tokens"))


@query(f"SELECT doc_id, CASE WHEN {tokens_sql('text')} <= 50 THEN text ELSE substr(text, 1, 192) END AS cut FROM documents")
def T4_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate("text", 50).alias("cut"))


@query(f"SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 59) || '…' END AS preview FROM (SELECT doc_id, {squeeze_sql('text')} AS s FROM documents)")
def T5_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview("text", 60).alias("preview"))


@query(r"SELECT item_id, replace(replace(regexp_replace(lower(text), '\s+', ' ', 'g'), ',', ''), '_', '') AS form FROM benchmark")
def T7_fact_form(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.fact_form("text").alias("form"))


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?'))) AS numbers FROM documents")
def T9_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.numbers_in("text")).cast("long").alias("numbers"))


HALVES_SQL = "SELECT doc_id, text, CAST(length(text) // 2 AS INT) AS h, length(text) AS n, doc_id % 5 AS k FROM documents WHERE length(text) >= 40"


@query(
    rf"WITH c AS (SELECT doc_id, text AS whole, 0 AS ord, 0 AS s, h AS e, CASE WHEN k = 3 THEN '?' || substr(text, 2, h - 1) ELSE substr(text, 1, h) END AS body FROM ({HALVES_SQL}) UNION ALL "
    rf"SELECT doc_id, text, 1, CASE k WHEN 1 THEN h - 1 WHEN 2 THEN h + 9 ELSE h END, CASE WHEN k = 4 THEN n - 9 ELSE n END, "
    rf"substr(text, CASE k WHEN 1 THEN h - 1 WHEN 2 THEN h + 9 ELSE h END + 1, CASE WHEN k = 4 THEN n - 9 ELSE n END - CASE k WHEN 1 THEN h - 1 WHEN 2 THEN h + 9 ELSE h END) FROM ({HALVES_SQL})), "
    r"p AS (SELECT doc_id, ord, CASE WHEN s < b THEN 'overlap' WHEN regexp_replace(substr(whole, b + 1, s - b), '\s', '', 'g') <> '' THEN 'gap' WHEN substr(whole, s + 1, e - s) <> body THEN 'drift' "
    r"WHEN ord = 1 AND regexp_replace(substr(whole, e + 1), '\s', '', 'g') <> '' THEN 'tail' END AS problem FROM (SELECT *, CASE WHEN ord = 0 THEN 0 ELSE lag(e) OVER (PARTITION BY doc_id ORDER BY ord) END AS b FROM c)) "
    "SELECT doc_id, CAST(ord AS VARCHAR) AS id, problem FROM p WHERE problem IS NOT NULL"
)
def C21_tiling(spark, sf_dir):
    """Documents in two halves, of which each fifth has another fault and a fifth none."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 40).select("doc_id", "text")
    n, k = F.length("text"), F.col("doc_id") % 5
    h = F.floor(n / 2).cast("int")
    second = F.when(k == 1, h - 1).when(k == 2, h + 9).otherwise(h)
    bounds = F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).alias("s"), h.alias("e")), F.struct(F.lit(1).alias("ord"), second.alias("s"), F.when(k == 4, n - 9).otherwise(n).alias("e")))
    rows = docs.select("doc_id", "text", F.inline(bounds))
    body = F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s"))
    altered = F.when((k == 3) & (F.col("ord") == 0), F.concat(F.lit("?"), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    chunks = rows.select("doc_id", F.col("ord").cast("string").alias("id"), "ord", F.col("s").alias("start_char"), F.col("e").alias("end_char"), altered.alias("text"))
    return C.tiling_problems(chunks, docs)


@query("SELECT doc_id, CAST(0 AS BIGINT) AS problems FROM documents")
def C20_chunks_tile(spark, sf_dir):
    """Every document's own chunks cover it without overlap, gap or drift."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("notes.md").alias("name"), "text")
    found = C.tiling_problems(C.chunk(docs), docs).groupBy("doc_id").agg(F.count("*").alias("problems"))
    return docs.select("doc_id").join(found, "doc_id", "left").fillna(0, ["problems"])


@query(f"SELECT event_id, regexp_extract(line, '\\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL|SEVERE)\\b', 1) AS level FROM ({LINES_SQL})")
def C5_log_level(spark, sf_dir):
    return event_lines(spark, sf_dir).select("event_id", T.log_level("line").alias("level"))


@query(
    "SELECT template, count(*) AS n FROM (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, "
    r"'\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}', '<TS>', 'g'), '\b\d{1,3}(?:\.\d{1,3}){3}\b', '<IP>', 'g'), '\b[A-Za-z]+-[0-9a-fA-F]{4,}\b', '<ID>', 'g'), "
    r"'(^|[^-0-9A-Za-z_.])\d+(?:ms)?\b', '\1<NUM>', 'g'), '(^|[^-0-9A-Za-z_.])\d+(?:ms)?\b', '\1<NUM>', 'g') AS template "
    f"FROM ({LINES_SQL})) GROUP BY template"
)
def C6_log_template(spark, sf_dir):
    return event_lines(spark, sf_dir).groupBy(T.log_template("line").alias("template")).agg(F.count("*").alias("n"))


@query(
    "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?][\"'')\\]]*)\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS pieces FROM documents"
)
def C11_sentence_pieces(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentence_pieces("text")).cast("long").alias("pieces"))


@query()
def C20_prose_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("notes.md").alias("name"), "text")
    return C.chunk(docs).select("doc_id", "id", "ord", "kind", "start_line", "end_line", "start_char", "end_char", "token_count", "merged_parts", "split_part")


@query(f"SELECT page_id, 'txt:' || md5({squeeze_sql('html')}) AS key FROM pages")
def D1_dedup_key(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), F.lit(None).cast("string").alias("template"))
    return rows.select("page_id", D.dedup_key().alias("key"))


FIRST_SQL = f"SELECT lang AS doc_id, doc_id AS ord, text, first_value(doc_id) OVER (PARTITION BY lang, {squeeze_sql('text')} ORDER BY doc_id) AS root FROM documents"


@query(f"SELECT doc_id, ord, CAST(root AS VARCHAR) AS root FROM ({FIRST_SQL})")
def D2_exact_dedup(spark, sf_dir):
    return D.deduplicate(by_source(spark, sf_dir, "lang")).select("doc_id", "ord", "root")


@query()
def D7_leader_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("label"), "vec_id", F.col("embedding").alias("vector"))
    return D.leader_clusters(rows, 0.40, "label", "vec_id").select("label", "vec_id", "leader", r6("similarity").alias("similarity"))


@query(
    f"SELECT doc_id, CAST(root AS VARCHAR) AS representative_id, count(*) + 1 AS size, CAST(sum({tokens_sql('text')}) AS BIGINT) AS absorbed_tokens FROM ({FIRST_SQL}) WHERE root <> ord GROUP BY doc_id, root"
)
def D10_clusters(spark, sf_dir):
    return D.clusters(D.deduplicate(by_source(spark, sf_dir, "lang"))).select("doc_id", "representative_id", F.col("size").cast("long").alias("size"), "absorbed_tokens")


@query(
    f"SELECT doc_id, CAST(sum(t) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN root = ord THEN t ELSE 0 END) AS BIGINT) AS tokens_out, CAST(sum(CASE WHEN root <> ord THEN t ELSE 0 END) AS BIGINT) AS claimed, "
    f"CAST(count(*) FILTER (root <> ord) AS BIGINT) AS absorbed FROM (SELECT *, {tokens_sql('text')} AS t FROM ({FIRST_SQL})) GROUP BY doc_id"
)
def D11_accounting(spark, sf_dir):
    return D.accounting(D.deduplicate(by_source(spark, sf_dir, "lang"))).select("doc_id", "tokens_in", "tokens_out", "claimed", "absorbed")


ENTROPY_SQL = (
    r"SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS token FROM documents) GROUP BY doc_id, token"
)


@query(
    f"SELECT doc_id, round(CASE WHEN n < 2 THEN 0 ELSE (log2(n) - s / n) / log2(n) * least(1, log2(n) / 6) END, 6) AS entropy FROM (SELECT doc_id, sum(c) AS n, sum(c * log2(c)) AS s FROM ({ENTROPY_SQL}) GROUP BY doc_id)"
)
def N2_entropy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("d").alias("id"), "text", F.lit(None).cast("string").alias("template"))
    return N.entropy(rows).select("doc_id", r6("entropy").alias("entropy"))


TERM_SQL = (
    r"SELECT source, doc_id, regexp_replace(t, '[.\-]+$', '') AS term FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_.\-]*')) AS t FROM documents)"
)


@query(
    f"WITH tf AS (SELECT source, doc_id, term, count(*) AS tf FROM ({TERM_SQL}) GROUP BY ALL), df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL), "
    "n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) "
    "SELECT CAST(doc_id AS VARCHAR) AS id, round(avg((1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1)), 6) AS tfidf FROM tf JOIN df USING (source, term) JOIN n USING (source) GROUP BY doc_id"
)
def N3_tfidf(spark, sf_dir):
    return N.tfidf(by_source(spark, sf_dir)).select("id", r6("tfidf").alias("tfidf"))


@query(
    "WITH d AS (SELECT label, k, avg(x) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings) GROUP BY ALL), "
    "n AS (SELECT label, sqrt(sum(m * m)) AS n FROM d GROUP BY label), "
    "e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS k FROM embeddings) "
    "SELECT vec_id, round(1 - sum(CAST(x AS DOUBLE) * m) / any_value(n), 6) AS novelty FROM e JOIN d USING (label, k) JOIN n USING (label) GROUP BY vec_id"
)
def N6_novelty(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    return N.novelty(rows, "label").select("vec_id", r6("novelty").alias("novelty"))


KEYWORDS_SQL = " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in N.KEYWORDS)


@query(f"SELECT doc_id, round(least(1, 0.5 + 0.25 * least(1, ({KEYWORDS_SQL}) / 2)), 6) AS structure FROM documents")
def N7_structure(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumns({"kind": F.lit("paragraph"), "level": F.lit(None).cast("string")})
    return rows.select("doc_id", r6(N.structure()).alias("structure"))


@query(
    "SELECT e.vec_id, round((list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) + 1) / 2, 5) AS relevance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
)
def N8_query_relevance(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row: the question
    return rows.crossJoin(F.broadcast(asked)).select("vec_id", F.round(N.query_relevance(F.col("embedding"), F.col("q")), 5).alias("relevance"))


@query(
    "SELECT doc_id, round(CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE greatest(0, least(1, (x - lo) / (hi - lo))) END, 6) AS scaled FROM (SELECT doc_id, x, "
    "CASE WHEN n < 8 THEN mn ELSE lo END AS lo, CASE WHEN n < 8 THEN mx ELSE hi END AS hi FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS x, source FROM documents) JOIN "
    "(SELECT source, count(*) AS n, min(n_chars) AS mn, max(n_chars) AS mx, quantile_cont(CAST(n_chars AS DOUBLE), 0.05) AS lo, quantile_cont(CAST(n_chars AS DOUBLE), 0.95) AS hi FROM documents GROUP BY source) USING (source))"
)
def N10_scaled(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("x", F.col("n_chars").cast("double"))
    return rows.select("doc_id", r6(N.scaled("x", "source")).alias("scaled"))


@query()
def N12_density(spark, sf_dir):
    live = D.deduplicate(turns(spark, sf_dir)).where("leader is null").drop("leader", "method", "similarity", "root")
    return N.score(live).select("doc_id", "ord", "density")


BUDGET_SQL = f"SELECT source, doc_id, {tokens_sql('text')} AS t, n_chars FROM documents"


def budget_sql(key: str, limit: str, least: int) -> str:
    return (
        f"WITH d AS ({BUDGET_SQL}), g AS (SELECT source, {limit} AS lim, list({{'id': doc_id, 't': t}} ORDER BY {key}) AS rows FROM d GROUP BY source), "
        "f AS (SELECT source, list_reduce(rows, lambda s, r: CASE WHEN s.used + r.t <= lim OR len(s.ids) < LEAST THEN {'used': s.used + r.t, 'ids': list_append(s.ids, r.id)} ELSE s END, "
        "{'used': 0, 'ids': []::BIGINT[]}) AS s FROM (SELECT source, lim, rows FROM g)) SELECT source, unnest(s.ids) AS doc_id FROM f"
    ).replace("LEAST", str(least))


def select_by(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    rows = by_source(spark, sf_dir).withColumn("density", F.length("text").cast("double"))
    originals = rows.groupBy("doc_id").agg(F.sum("token_count").alias("original_tokens"))
    found = K.select(rows, originals, strategy=strategy).where("selected")
    return found.select(F.col("doc_id").alias("source"), F.col("id").cast("bigint").alias("doc_id"))


@query()
def K4_budget_select(spark, sf_dir):
    return select_by(spark, sf_dir, "density")


@query()
def K5_truncate_select(spark, sf_dir):
    return select_by(spark, sf_dir, "truncate")


@query()
def K6_random_select(spark, sf_dir):
    return select_by(spark, sf_dir, "random")


RUNS_SQL = (
    "SELECT source, doc_id, n_chars, selected, sum(CAST(selected AS INT)) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM (SELECT *, n_chars > 1000 AS selected FROM documents)"
)


@query(f"SELECT source, min(doc_id) AS first_doc, count(*) AS sections, CAST(sum(n_chars) AS BIGINT) AS tokens FROM ({RUNS_SQL}) WHERE NOT selected GROUP BY source, run")
def R1_drop_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), F.lit("paragraph").alias("kind"),
        F.lit(None).cast("string").alias("symbol"), F.col("n_chars").alias("token_count"), (F.col("n_chars") > 1000).alias("selected"),
        *[F.lit(0).alias(c) for c in ("start_line", "end_line", "start_char", "end_char")],
    )
    return R.drop_runs(rows).select(F.col("doc_id").alias("source"), F.col("ord").alias("first_doc"), "sections", "tokens")


_runs: dict[tuple, Compression] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of each file of a table: what it reads changes if one of them does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


def marked(spark: SparkSession, sf_dir: str) -> Compression:
    """The compression of all documents; its stages are written tables, so one run serves several queries until the table changes."""
    key = (spark.sparkContext.applicationId, _state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _runs:
        for old in list(_runs):
            run = _runs.pop(old)
            if old[0] == key[0]:
                run.release()
        docs = table(spark, sf_dir, "documents")
        name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
        _runs[key] = compress(docs.select("doc_id", name.alias("name"), "text"))
    return _runs[key]


@query()
def R12_stage_metrics(spark, sf_dir):
    return marked(spark, sf_dir).stage_metrics()


@query()
def compress_by_language(spark, sf_dir):
    """The flagship: every document to 30 % of its tokens, kept and dropped by language."""
    docs = table(spark, sf_dir, "documents")
    rows = marked(spark, sf_dir).summary().join(docs.select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(
        F.count("*").alias("documents"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"),
        F.sum("kept").alias("kept"), F.sum("dropped").alias("dropped"), F.sum("absorbed").alias("absorbed"),
    )


@query(
    f"SELECT lang, round(sum({tokens_sql('text')}) * 0.15 / 1e6, 8) AS cost FROM documents GROUP BY lang"
)
def E6_cost(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select("lang", F.lit("gpt-4o-mini").alias("model"), T.token_count("text").alias("tokens_in"), F.lit(0).alias("tokens_out"))
    sums = runs.groupBy("lang", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return V.cost(sums, V.prices(spark)).select("lang", F.round("cost", 8).alias("cost"))


@query("SELECT source, doc_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM documents")
def S5_combine_ranges(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("pos"), F.lit("done").alias("status"), "text")
    return S.source_files(files, "source").select("source", F.col("pos").alias("doc_id"), "start")


@query("SELECT doc_id, 'done' AS status, length(trim(text)) AS characters FROM documents")
def S2_extract(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.concat(F.lit("up/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.trim("text").cast("binary").alias("content"))
    return S.extract(files).select(F.col("pos").alias("doc_id"), "status", F.col("characters").cast("long").alias("characters"))


@query(
    f"SELECT lang, quality, count(*) AS n, CAST(sum({tokens_sql('text')}) AS BIGINT) AS tokens FROM documents JOIN labels USING (doc_id) GROUP BY lang, quality"
)
def label_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum(T.token_count("text")).alias("tokens"))


@query("SELECT item_id, 64 AS dim, CAST(1 AS DOUBLE) AS norm FROM benchmark")
def P4_hash_embeddings(spark, sf_dir):
    rows = E.embed(table(spark, sf_dir, "benchmark"), E.hashing_embedder(64))
    return rows.select("item_id", F.size("vector").alias("dim"), F.round(E.norm(F.col("vector")), 4).alias("norm"))


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))) AS kinds FROM documents")
def T3_token_kinds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(T.token_list("text"))).cast("long").alias("kinds"))


@query(f"SELECT page_id, md5({squeeze_sql('html')}) AS squeezed FROM pages")
def T6_squeeze(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.squeeze("html").cast("binary")).alias("squeezed"))


@query("SELECT conv_id AS doc_id, turn AS pos, CASE WHEN length(text) > 0 THEN 'turn-' || turn ELSE 'talk.txt' END AS source_file FROM conversations")
def J1_provenance(spark, sf_dir):
    """The middle of every turn, found again in the ranges of its combined conversation."""
    files = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("name"), F.lit("done").alias("status"), "text"
    )
    ranges = S.source_files(files)
    middle = ((F.col("start") + F.col("end")) / 2).cast("int").alias("start_char")
    chunks = ranges.select("doc_id", "pos", middle, F.lit("talk.txt").alias("source"))
    return S.with_provenance(chunks, ranges).select("doc_id", "pos", "source_file")


@query(
    "SELECT lang, text_id, round(coalesce(ln(n) / nullif(max(ln(n)) OVER (PARTITION BY lang), 0), 0), 6) AS frequency FROM "
    "(SELECT lang, min(doc_id) AS text_id, count(*) AS n FROM documents GROUP BY lang, text)"
)
def N9_frequency(spark, sf_dir):
    once = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("doc_id"), "text").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("duplicate_count"))
    return once.select(F.col("doc_id").alias("lang"), "text_id", r6(N.frequency()).alias("frequency"))


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their source; the longer a text, the denser, and those of over 1,000 characters are selected."""
    size = F.length("text")
    return by_source(spark, sf_dir).withColumns({"density": size.cast("double"), "selected": size > 1000})


@query(
    "SELECT source AS doc_id, CAST(min(length(text)) AS DOUBLE) AS least, median(CAST(length(text) AS DOUBLE)) AS median, CAST(max(length(text)) AS DOUBLE) AS most FROM documents GROUP BY source"
)
def N13_score_stats(spark, sf_dir):
    return N.score_stats(sized(spark, sf_dir))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS INT) AS rank FROM documents")
def N14_ranked(spark, sf_dir):
    return N.ranked(sized(spark, sf_dir)).select(F.col("ord").cast("long").alias("doc_id"), "rank")


@query(
    "SELECT doc_id, rank, round(100 * (1 - rank / n), 6) AS percentile FROM (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS INT) AS rank, "
    "count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE contains(text, 'on')"
)
def N15_grep_rank(spark, sf_dir):
    return N.grep_rank(sized(spark, sf_dir), "on").select(F.col("ord").cast("long").alias("doc_id"), "rank", r6("percentile").alias("percentile"))


@query(
    "SELECT doc_id, CAST(rank AS INT) AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE length(text) <= 1000) WHERE rank <= 50"
)
def K12_audit(spark, sf_dir):
    return K.audit(sized(spark, sf_dir)).select(F.col("ord").cast("long").alias("doc_id"), "rank")


@query(
    f"SELECT source AS doc_id, CAST(sum(t) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN n > 1000 THEN t ELSE 0 END) AS BIGINT) AS tokens_out, count(*) FILTER (n > 1000) AS kept, count(*) FILTER (n <= 1000) AS dropped, "
    f"CAST(greatest(1, round_even(sum(t) * 0.3, 0)) AS BIGINT) AS budget FROM (SELECT source, length(text) AS n, {tokens_sql('text')} AS t FROM documents) GROUP BY source"
)
def K13_metrics(spark, sf_dir):
    rows = sized(spark, sf_dir)
    found = K.metrics(rows, rows.groupBy("doc_id").agg(F.sum("token_count").alias("original_tokens")))
    return found.select("doc_id", "tokens_in", "tokens_out", "kept", "dropped", F.col("budget").cast("long").alias("budget"))


@query(
    f"SELECT doc_id, CAST(rank AS INT) AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY t DESC, doc_id) AS rank FROM (SELECT source, doc_id, text, {tokens_sql('text')} AS t FROM documents) "
    "WHERE length(text) > 1000 AND t >= 150) WHERE rank <= 12"
)
def K14_rewrite_candidates(spark, sf_dir):
    return K.rewrite_candidates(sized(spark, sf_dir)).select(F.col("ord").cast("long").alias("doc_id"), "rank")


@query()
def R11_summary(spark, sf_dir):
    return marked(spark, sf_dir).summary()


ORACLES["K4_budget_select"] = budget_sql("n_chars DESC, doc_id", "greatest(1, CAST(floor(greatest(1, CAST(round_even(sum(t) * 0.3, 0) AS INT)) * 0.97) AS INT))", 1)
ORACLES["K5_truncate_select"] = budget_sql("doc_id", "greatest(1, CAST(round_even(sum(t) * 0.3, 0) AS INT))", 0)
