"""The compression writes texts once, and its narrow signals are those of the operators."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terselake.functions import text as T
from terselake.operators import chunk as C
from terselake.operators import dedup as D
from terselake.operators import density as N
from terselake.operators import select as K
from terselake.operators.stream import whole
from terselake.plans.compress import compress

LINES = "\n".join(f"2024-01-05 10:11:{i:02d} {'ERROR' if i % 5 == 0 else 'INFO'} api took {i}ms of /var/x_{i % 3}" for i in range(40))
CODE = "import os\n\n\ndef load(path):\n    return parse_all(os.read(path))\n\n\ndef parse_all(found):\n    return [x.strip() for x in found]\n" * 2
PROSE = "\n\n".join(f"Paragraph {i % 9} says that node {i % 9 * 7} failed after {i % 9} ms, see https://a.b/c_{i % 9} or fooBar (ABC) in São-Paulo. " for i in range(30))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [("a.log", LINES), ("b.py", CODE), ("c.md", PROSE), ("d.md", "one"), ("e.md", ""), ("f.md", None), ("g.md", PROSE[:700])]
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts)], "doc_id bigint, name string, text string")


def test_texts_are_written_once(spark, docs):
    run = compress(docs)
    with_text = [p for p in run.paths if "text" in spark.read.parquet(p).columns]
    assert len(with_text) == 1
    for figures in (run.summary(), run.stage_metrics(), run.rebuild_metrics()):
        assert figures.count() and not [f for f in figures.inputFiles() if with_text[0].rsplit("/", 1)[1] in f]
    tokens = run.texts.select("doc_id", T.token_count("compressed").alias("n"))
    assert tokens.exceptAll(run.sizes).count() == 0 == run.sizes.exceptAll(tokens).count()
    assert {"text", "density_parts", "density", "section", "template", "level", "selected"} <= set(run.survivors.columns)
    run.release()


def test_signals_found_early_are_those_of_the_operators(docs):
    chunks = C.chunk(docs)
    early = N.measured(K.named(D.keyed(chunks)), together=True)
    live = D.deduplicate(chunks).where("leader is null")
    assert live.count() < chunks.count()
    want = live.join(N.tfidf(live), ["doc_id", "id"]).select(
        "doc_id", "id", F.round("tfidf", 9).alias("tfidf"), F.round(N.entropy_of(N.analysis_text()), 9).alias("entropy"), F.round(N.entities(), 9).alias("entities"), N.structure().alias("structure"),
        T.word_count("text").alias("words"), D.dedup_key().alias("key"), D.label().alias("label"),
    )
    rows = early.join(live.select("doc_id", "id"), ["doc_id", "id"])
    got = rows.select("doc_id", "id", *[F.round(c, 9).alias(c) for c in ("tfidf", "entropy", "entities")], "structure", "words", F.col("dedup_key").alias("key"), "label")
    assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
    uses = K.references(chunks).groupBy("doc_id", "id").agg(F.sort_array(F.collect_set("name")).alias("uses"))
    assert uses.exceptAll(K.named(chunks).where("size(uses) > 0").select("doc_id", "id", "uses")).count() == 0 < uses.count()
    narrow, old = D.deduplicate(D.keyed(chunks).drop("text")), D.roots(D.structural_pass(D.exact_pass(D.unmarked(chunks))))
    assert narrow.select("doc_id", "id", "root").exceptAll(old.select("doc_id", "id", "root")).count() == 0


def test_guards_of_entity_patterns_lose_no_match(docs):
    texts = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), F.col("text").alias("t")).withColumn("t", F.substring("t", F.col("k") * 50 + 1, F.lit(60)))
    row = lambda k: T.count_matches("t", T.ENTITY_PATTERNS[k])
    plain = {k: row(k) for k in ("signatures", "numbers", "measurements", "dotted", "urls", "proper_nouns")} | {"identifiers": row("snake") + row("camel") + row("constants")}
    counts = texts.select(T.entity_counts("t").alias("c"), *[v.alias(k) for k, v in plain.items()])
    assert counts.where(" or ".join(f"not (c.{k} <=> {k})" for k in plain)).count() == 0 < counts.where("numbers > 0").count()


def test_documents_leave_a_stream_whole():
    ids = [1, 1, 2, 3, 3, 3, 3, 4, None, None, 5]
    for size in (1, 2, 3, 20):
        batches = [pa.RecordBatch.from_pydict({"doc_id": ids[i : i + size]}) for i in range(0, len(ids), size)]
        found = [t.column("doc_id").to_pylist() for t in whole(iter([batches[0].slice(0, 0), *batches]))]
        assert sum(found, []) == ids and all(a[-1] != b[0] for a, b in zip(found, found[1:], strict=False))


def test_line_dedup_hashes_a_text_once(spark, docs):
    """The hash of the text stands below the explode of its places, not above it for every place."""
    import io
    from contextlib import redirect_stdout

    from terselake.llm import line_dedup as L

    seen, real = [], L.materialise
    try:
        L.materialise = lambda df, label, *a, **k: seen.append((label, df)) or real(df, label, *a, **k)
        L.dedup_lines(docs.select("doc_id", "text")).count()
    finally:
        L.materialise = real
    out = io.StringIO()
    with redirect_stdout(out):
        dict(seen)["places"].explain("simple")
    above = out.getvalue().split("Generate")[0]
    assert "explode" in out.getvalue() and "octet_length(text" not in above
    assert "Filter" not in out.getvalue()  # it would find the places a second time
