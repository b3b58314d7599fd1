"""Rebuilt texts of any size: their digests and sizes come without the text in one row."""

import hashlib
import io
import os
import re
from contextlib import redirect_stdout

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from terselake.operators import rebuild as R

CASES = {
    1: [("log_record", "a b"), ("log_record", "c  "), ("paragraph", "d, e")],
    2: [("paragraph", "")],
    3: [("paragraph", None), ("paragraph", "")],
    4: [("paragraph", None)],
    5: [("paragraph", " \t"), ("log_record", "ä" * 3), ("log_record", None), ("log_record", "x.y")],
}


def parts(spark):
    rows = [(d, n, str(n), k, t, True) for d, found in CASES.items() for n, (k, t) in enumerate(found)]
    chunks = spark.createDataFrame(rows, "doc_id bigint, ord int, id string, kind string, text string, selected boolean")
    marks = spark.createDataFrame([(1, 1, 2, "[x2 #c0]"), (5, 0, 0, "[... omitted #d0 ...]"), (6, 0, 0, "alone")], "doc_id bigint, ord int, place int, text string")
    return chunks, marks


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_digests_and_sizes_are_those_of_the_text(spark):
    from terselake.functions import text as T

    chunks, marks = parts(spark)
    for m in (None, marks):
        whole = R.stitch(chunks, m).withColumn("again", T.token_count("compressed")).collect()
        assert len(whole) == (5 if m is None else 6) and all(r["compressed_tokens"] == r["again"] for r in whole)
        want = {r["doc_id"]: (hashlib.md5(r["compressed"].encode()).hexdigest(), r["compressed_tokens"]) for r in whole}
        assert {r["doc_id"]: (r["compressed"], r["compressed_tokens"]) for r in R.digests(chunks, m).collect()} == want
        assert {r["doc_id"]: r["compressed_tokens"] for r in R.sizes(chunks, m).collect()} == {d: n for d, (_, n) in want.items()}
    worded = chunks.withColumn("body_words", T.word_count(R.body())).drop("text")
    assert R.sizes(worded, marks).exceptAll(R.sizes(chunks, marks)).count() == 0


def test_metrics_of_languages_gather_no_texts(spark, tmp_path):
    """R8 needs sizes only, R5 a digest: neither sorts or gathers the texts of a language in one row."""
    from terselake.plans import operator_queries as Q

    rows = [(i, f"{'long words ' * (i % 3 * 60)}{i}", "en" if i % 2 else "de", "web") for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (Q.R5_stitch, Q.R8_rebuild_metrics):
        found = query(spark, str(tmp_path))
        assert found.count() == 2 and "gap" not in plan(found)
    assert "Exchange" in plan(found) and not [x for x in plan(found).splitlines() if "Window" in x and " text#" in x]
    assert Q.R8_rebuild_metrics(spark, str(tmp_path)).agg(F.sum("markers")).first()[0] > 0


def direct(spark):
    """Bytes of the JVM's buffers outside its heap."""
    pools = spark._jvm.java.lang.management.ManagementFactory
    return sum(p.getMemoryUsed() for p in pools.getPlatformMXBeans(spark._jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")) if p.getName() == "direct")


def test_metrics_hold_a_row_group_once(spark, tmp_path, monkeypatch):
    """R8 over one file of one row group: its texts are read once, dealt without a sort, and pass through no second buffer of their size."""
    from terselake.plans import operator_queries as Q

    rows, size = 6000, 4096
    texts = [os.urandom(size).hex() for _ in range(rows)]
    table = pa.table({"doc_id": pa.array(range(rows), pa.int64()), "text": texts, "lang": ["en" if i % 2 else "de" for i in range(rows)], "source": ["web"] * rows})
    pq.write_table(table, tmp_path / "documents.parquet", compression="none", use_dictionary=False)
    plans, keep, before = [], Q.materialise, direct(spark)
    monkeypatch.setattr(Q, "materialise", lambda df, *a: plans.append(plan(df)) or keep(df, *a))
    found = Q.R8_rebuild_metrics(spark, str(tmp_path))
    got = {r["doc_id"]: (r["markers"], r["content_tokens"]) for r in found.collect()}
    assert got == {g: (0, round(rows / 2 * 1.3)) for g in ("en", "de")}
    assert direct(spark) - before < rows * size
    reads = [p for p in [*plans, plan(found)] for _ in re.findall(r"FileScan parquet \[[^]]*\btext#", p)]
    assert len(reads) == 1 and "hashpartitioning" in reads[0] and "RoundRobin" not in reads[0]
