"""Operators against small literals and the invariants they promise."""

import pytest
from pyspark.sql import functions as F

from terselake.functions import text as T
from terselake.operators import chunk as C
from terselake.operators import dedup as D
from terselake.operators import density as N
from terselake.operators import embed as E
from terselake.operators import evaluate as V
from terselake.operators import rebuild as R
from terselake.operators import rewrite as A
from terselake.operators import select as K
from terselake.operators.prose import python_spans, sentence_bounds, spans_of
from terselake.plans.compress import STAGES, compress
from terselake.sources import config, ingest

LOG = """2024-01-05 10:11:12 INFO api user=usr_1234 took 20ms
2024-01-05 10:11:13 INFO api user=usr_9876 took 31ms
2024-01-05 10:11:14 ERROR api pool exhausted
Traceback (most recent call last):
  File "pool.py", line 8, in take
PoolTimeout: none left
2024-01-05 10:11:15 INFO api user=usr_5555 took 7ms
"""
PROSE = """# Root cause

The pool was too small. Dr. Vega saw it first! Why? Nobody asked.

- one item
- another item

```python
x = 1
```

A last paragraph about nothing in particular, long enough to be on its own here.
"""


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def docs(spark, *rows):
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "doc_id bigint, name string, text string")


@pytest.mark.parametrize(("text", "n"), [("", 0), (" ", 1), ("one", 1), ("a b c d e", 6), ("a, b", 4)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.token_count("t"), t=text) == n


@pytest.mark.parametrize(
    ("text", "fact", "there"),
    [("it took 86,000 rows", "8", False), ("limit 600_000", "600,000", True), ("7912ms", "7912", True), ("v1.8", "8", False), ("the cat sat", "cat", True), ("concatenate", "cat", False), ("a.b(c)", "a.b(c)", True)],
)
def test_fact_present(spark, text, fact, there):
    assert one(spark, T.fact_present("t", F.array(F.lit(fact))), t=text) is there


def test_templates_keep_what_tells_records_apart(spark):
    t = one(spark, T.log_template("t"), t="2024-01-05 10:11:12 eu-west-1 v2.31.0 ORD-427039 from 10.0.0.1 in 8.4s")
    assert t == "<TS> eu-west-1 v2.31.0 <ID> from <IP> in <NUM>"


def test_redaction_and_names(spark):
    assert one(spark, T.redact("t"), t="key sk-abcdefghijklmnop end") == "key [redacted] end"
    assert one(spark, T.infer_filename("t"), t=LOG) == "pasted.log"
    assert one(spark, T.infer_filename("t"), t="import os\nx = 1") == "pasted.py"
    assert one(spark, T.preview("t", 5), t=" a  bcdefg ") == "a bc…"


def test_log_records_hold_their_traces(spark):
    rows = C.chunk(docs(spark, ("a.log", LOG))).orderBy("ord").collect()
    assert [r["lines"] for r in rows] == [1, 1, 4, 1]
    assert rows[2]["level"] == "ERROR" and rows[2]["start_line"] == 3 and rows[2]["end_line"] == 6
    assert rows[0]["template"] == rows[1]["template"]


def test_chunks_tile_their_document(spark):
    d = docs(spark, ("a.log", LOG), ("b.md", PROSE), ("c.py", "import os\n\n\ndef f(x):\n    return x\n"), ("d.txt", ""), ("e.txt", "  \n"))
    chunks = C.chunk(d)
    assert C.tiling_problems(chunks, d).count() == 0
    assert {r["doc_id"] for r in chunks.select("doc_id").distinct().collect()} == {0, 1, 2}


def test_prose_kinds_and_sections():
    kinds = [(s.kind, s.section) for s in spans_of(PROSE, "b.md")]
    assert ("code_block", "Root cause") in kinds and all(s == "Root cause" for _, s in kinds)
    bounds = sentence_bounds(PROSE, 14, 78)
    assert [PROSE[a:b] for a, b in bounds][:2] == ["The pool was too small.", "Dr. Vega saw it first!"]


def test_large_classes_split_into_methods():
    body = "".join(f"    def m{i}(self, value):\n" + "        total = value + 1; other = total * 2; print(total, other)\n" * 8 for i in range(4))
    kinds = [s.kind for s in python_spans("class A:\n    x = 1\n\n" + body)]
    assert kinds.count("method") == 4 and python_spans("def (") is None


def test_exact_and_structural_dedup(spark):
    shape = "def {n}(value):\n    if len(value) > {k}:\n        raise ValueError('too long')\n    cleaned = value.strip()\n    return cleaned.lower() if cleaned else None\n"
    rows = [(1, str(i), i, "function", shape.format(n=n, k=k), 40) for i, (n, k) in enumerate([("a", 64), ("b", 64), ("c", 128)])]
    df = spark.createDataFrame(rows, "doc_id bigint, id string, ord int, kind string, text string, token_count int")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("template", "symbol", "level")})
    found = {r["id"]: r["root"] for r in D.deduplicate(df).collect()}
    assert found == {"0": "0", "1": "0", "2": "2"}
    books = D.accounting(D.deduplicate(df)).first()
    assert books["removed"] == books["claimed"] == 40


def test_leaders(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.9, 0.1]), (1, 3, [0.0, 0.0])], "doc_id bigint, ord int, vector array<double>")
    found = {r["ord"]: r["leader"] for r in D.leader_clusters(rows, 0.8).collect()}
    assert found == {0: 0, 1: 1, 2: 0, 3: 3}


def test_scaling_small_large_and_flat(spark):
    df = spark.createDataFrame([("few", float(i)) for i in range(3)] + [("flat", 1.0)] * 9 + [("many", float(i)) for i in range(20)] + [("many", 1e6)], "doc_id string, x double")
    rows = df.select("doc_id", "x", N.scaled("x").alias("s")).collect()
    assert {r["s"] for r in rows if r["doc_id"] == "flat"} == {0.5}
    assert sorted(r["s"] for r in rows if r["doc_id"] == "few") == [0.0, 0.5, 1.0]
    assert max(r["s"] for r in rows) == 1.0


def test_selection_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, "a", 0, "paragraph", 90, 0.9), (1, "b", 1, "paragraph", 20, 0.8), (1, "c", 2, "query", 5, 1.0)], "doc_id bigint, id string, ord int, kind string, token_count int, density double")
    total = spark.createDataFrame([(1, 100)], "doc_id bigint, original_tokens int")
    found = {r["id"]: r["drop_reason"] for r in K.select(rows, total).collect()}
    assert found == {"a": "budget_exhausted", "b": "density", "c": "protected"}


def test_dependencies_are_mended():
    import pandas as pd

    base = {"doc_id": 1, "kind": "function", "start_line": 1, "end_line": 2, "words": 3, "duplicate_count": 1, "method": None, "absorbed_tokens": None, "cluster_id": None}
    rows = pd.DataFrame(
        [
            base | {"id": "call", "ord": 0, "symbol": "call", "token_count": 30, "density": 0.9, "defines": ["call"], "uses": ["helper"]},
            base | {"id": "noise", "ord": 1, "symbol": "noise", "token_count": 30, "density": 0.5, "defines": ["noise"], "uses": []},
            base | {"id": "helper", "ord": 2, "symbol": "helper", "token_count": 20, "density": 0.1, "defines": ["helper"], "uses": []},
        ]
    )
    chosen = K.Picker(rows, 62).run(1, 0.03, True, False)
    assert {i: (s, r) for i, s, r in chosen} == {"call": (True, "density"), "noise": (False, "evicted_for_dependency"), "helper": (True, "dependency")}


def test_verdicts(spark):
    rows = [("keep 64 and load_rows", "load_rows 64", 20), ("keep 64", "none", 20), ("a b", "a b", 1), ("x", None, 5), ("snake_case other_name", "snake_case", 20)]
    df = spark.createDataFrame(rows, "original string, candidate string, token_count int")
    assert [r["reason"] for r in A.verdicts(df).collect()] == [None, "numbers_lost", "no_gain", "no_response", "entity_overlap"]


def test_survival_and_cost(spark):
    items = spark.createDataFrame([("i", "c", [["64"], ["pool", "queue"]])], "id string, context string, key_facts array<array<string>>")
    texts = spark.createDataFrame([("c", "the queue holds 640")], "context string, text string")
    rows = {r["context"]: (r["present"], r["facts"]) for r in V.fact_survival(items, texts).collect()}
    assert rows == {"c": (1, 2), None: (1, 2)}
    runs = spark.createDataFrame([("gpt-4o", 1000, 100)], "model string, tokens_in long, tokens_out long")
    assert V.cost(runs, V.prices(spark)).first()["cost"] == pytest.approx(0.0035)
    with pytest.raises(Exception, match="no price"):
        V.cost(runs.withColumn("model", F.lit("other")), V.prices(spark)).collect()


def test_uploads(spark):
    files = spark.createDataFrame([(0, "x/a.txt", bytearray(b"hello")), (1, "b.exe", bytearray(b"x")), (2, "c.md", bytearray(b"a\x00b")), (3, "d.log", bytearray(b"")), (4, "e.txt", bytearray(b"ok \xff"))], "pos int, name string, content binary")
    rows = ingest.extract(files)
    assert [r["status"] for r in rows.orderBy("pos").collect()] == ["done", "skipped", "skipped", "skipped", "done"]
    joined = ingest.combine(rows.withColumn("doc_id", F.lit(1))).first()
    assert joined["name"] == "uploads.txt" and joined["text"].startswith("hello\n\nok")


def test_config_is_strict():
    assert config.load(overrides={"selection": {"ratio": 0.5, "reserve": None}}).selection.ratio == 0.5
    with pytest.raises(ValueError, match="selection.nope"):
        config.load(overrides={"selection": {"nope": 1}})


def test_chain_cools_down_but_not_after_a_timeout():
    now = [0.0]

    def fail():
        raise ValueError("quota")

    def slow():
        raise TimeoutError("late")

    chain = E.Chain([("a", True, fail), ("b", True, slow), ("c", False, None), ("d", True, lambda: 7)], clock=lambda: now[0])
    assert chain.run() == ("d", 7) and chain.run() == ("d", 7)
    assert [a.outcome for a in chain.attempts] == ["failed", "timeout", "unconfigured", "ok", "cooling", "timeout", "unconfigured", "ok"]
    with pytest.raises(RuntimeError, match="a: failed quota"):
        E.Chain([("a", True, fail)]).run()
    assert E.choose(["openai", "local"], "cloud") == ["openai"] and not E.retryable("HTTP 429")


def test_compression_end_to_end(spark):
    long = "\n\n".join(f"Paragraph {i} says that node {i * 7} failed after {i * 31} ms because the cache of shard {i} was cold and slow." for i in range(40))
    run = compress(docs(spark, ("a.md", long), ("b.log", LOG * 5), ("c.txt", "")), query="which node failed")
    rows = {r["doc_id"]: r for r in run.summary().collect()}
    assert 0 < rows[0]["compressed_tokens"] <= 0.35 * rows[0]["original_tokens"]
    assert rows[1]["absorbed"] > 0 and rows[2]["original_tokens"] == rows[2]["compressed_tokens"] == 0
    stages = run.stage_metrics().where("doc_id = 2").orderBy("no").collect()
    assert [s["stage"] for s in stages] == list(STAGES) and {s["status"] for s in stages} == {"skipped"}
    text = run.texts.where("doc_id = 0").first()["compressed"]
    assert "which node failed" in text and "[... omitted #d" in text
    assert R.expand(run.markers, run.chunks).count() == run.markers.count()


def test_streaming_dedup(spark, tmp_path):
    from terselake.streaming.logs import first_of_template

    rows = [("2024-01-01 00:00:01", "INFO user=usr_1234 in"), ("2024-01-01 00:00:02", "INFO user=usr_9999 in"), ("2024-01-01 00:00:03", "WARN disk low")]
    spark.createDataFrame(rows, "t string, line string").select(F.to_timestamp("t").alias("ts"), "line").write.parquet(str(tmp_path / "in"))
    stream = first_of_template(spark.readStream.schema("ts timestamp, line string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2


def test_runs_of_spans_against_a_step_by_step_version():
    import random

    from terselake.operators import prose as P

    rng = random.Random(4)
    kinds = ("heading", "paragraph", "list", "code_block", "module_level")
    for _ in range(300):
        spans, at = [], 0
        for _ in range(rng.randint(0, 12)):
            n = rng.choice((1, 3, 8, 9, 20, 90, 200, 310))
            spans.append(P.Span(at, at + n * 6, rng.choice(kinds), n))
            at += n * 6 + 2
        # Step by step: a span joins what stands before it if the rule allows, else it stands on its own.
        ahead = []
        for s in spans:
            last = ahead[-1] if ahead else None
            if last and last["opens"] and P.estimate(last["n"]) < 12 and s.kind != "code_block" and P.estimate(last["n"] + s.words) <= 400:
                ahead[-1] = {"a": last["a"], "b": s.end, "n": last["n"] + s.words, "kind": s.kind, "opens": True, "anchor": True}
            else:
                ahead.append({"a": s.start, "b": s.end, "n": s.words, "kind": s.kind, "opens": s.kind == "heading", "anchor": False})
        out = []
        for s in ahead:
            last = out[-1] if out else None
            small = last and (P.estimate(last["n"]) < 12 or P.estimate(s["n"]) < 12)
            if small and "code_block" not in (last["kind"], s["kind"]) and s["kind"] != "heading" and not s["anchor"] and P.estimate(last["n"]) + P.estimate(s["n"]) <= 400:
                kind = last["kind"] if last["b"] - last["a"] >= s["b"] - s["a"] else s["kind"]
                out[-1] = {**last, "b": s["b"], "n": last["n"] + s["n"], "kind": kind}
            else:
                out.append(s)
        assert [(s.start, s.end, s.kind, s.words) for s in P.merge_small(spans)] == [(s["a"], s["b"], s["kind"], s["n"]) for s in out]


def test_large_texts_are_packed_to_the_target():
    from terselake.operators import prose as P

    text = " ".join(f"Sentence {i} says that shard {i * 3} of the store was slow again today." for i in range(80))
    spans = spans_of(text, "a.md")
    assert len(spans) > 5 and all(s.tokens <= 120 for s in spans) and [s.split_part for s in spans] == list(range(len(spans)))
    assert all(a.tokens + P.estimate(P.words(text[b.start : text.index(".", b.start) + 1])) > 120 for a, b in zip(spans, spans[1:], strict=False))
    wide = spans_of(text, "a.md", sizes=P.Chunking(target_tokens=300))
    assert len(wide) < len(spans) and len(spans_of(text, "a.md", sizes=P.Chunking(max_tokens=10**6))) == 1


def test_a_module_with_few_errors_is_still_split():
    good = "".join(f"def f{i}(x):\n    y = x + {i}\n    return y * 2\n\n\n" for i in range(6))
    kinds = [(s.kind, s.symbol) for s in python_spans("import os\n\n" + good + "def broken(:\n    pass\n")]
    assert [k for k in kinds if k[0] == "function"] == [("function", f"f{i}") for i in range(6)] and kinds[-1][0] == "module_level"
    assert python_spans("def a(:\n    x\n\ndef b(:\n    y\n\ndef c(x):\n    return x\n") is None


def test_lines_and_totals_of_chunks(spark):
    text = "\n\n# One\n\n" + "\n".join(f"line {i} of the first part with a few more words" for i in range(5)) + "\n\n- a\n- b\n\n\nEnd of it all, which is long enough to stay on its own here."
    for r in C.chunk(docs(spark, ("a.md", text))).collect():
        assert r["text"] == text[r["start_char"] : r["end_char"]]
        assert r["start_line"] == 1 + text[: r["start_char"]].count("\n") and r["end_line"] == 1 + text[: r["end_char"]].count("\n")
        assert r["token_count"] == one(spark, T.token_count("t"), t=r["text"])


def test_each_document_its_own_question(spark):
    from terselake.plans.compress import compare_strategies, compress_items

    parts = [f"Node {i} of the fleet restarted after {i * 31} ms because its cache of shard {i * 7} was cold, slow and nearly full." for i in range(30)]
    contexts = spark.createDataFrame([("fleet", "fleet.md", "\n\n".join(parts)), ("empty", "e.md", "")], "context string, name string, text string")
    items = spark.createDataFrame([("a", "fleet", "what of node 7?", [["217"]]), ("b", "fleet", "what of node 9?", [["279"]]), ("c", "fleet", "what of node 7?", [["node 1"]])], "id string, context string, question string, key_facts array<array<string>>")
    both, run = compress_items(items, contexts, embedder=E.hashing_embedder(64))
    ids = {r["id"]: r["doc_id"] for r in both.collect()}
    texts = {r["doc_id"]: r["compressed"] for r in run.texts.collect()}
    assert ids["a"] == ids["c"] != ids["b"] and len(texts) == 2
    assert "what of node 7?" in texts[ids["a"]] and "what of node 9?" in texts[ids["b"]] and "what of node 9?" not in texts[ids["a"]]
    metrics = {r["doc_id"]: r for r in run.rebuild_metrics().collect()}
    assert all(m["markers"] > 0 and 0 < m["content_tokens"] < m["tokens_out"] for m in metrics.values())
    run.release()
    found = {(r["strategy"], r["ratio"], r["context"]): r for r in compare_strategies(items, contexts).collect()}
    assert len(found) == 9 * 2 and all(r["facts"] == 3 for r in found.values())
    assert all(found[s, 0.15, None]["tokens"] < found[s, 0.5, None]["tokens"] for s in ("truncate", "random", "density"))


def test_settings_are_read(spark):
    c = config.load(overrides={"chunking": {"target_tokens": 50}, "dedup": {"min_shape_tokens": 5}, "density": {"frequency_boost": 0.5}, "rewrite": {"overlap": 0.5}, "evaluation": {"num_ctx": 10}})
    assert (c.chunking.target_tokens, c.dedup.min_shape_tokens, c.density.frequency_boost, c.rewrite.overlap, c.evaluation.num_ctx) == (50, 5, 0.5, 0.5, 10)
    text = " ".join(f"Sentence {i} says that shard {i * 3} of the store was slow again today." for i in range(80))
    few, many = (compress(docs(spark, ("a.md", text)), config=x).chunks.count() for x in (None, c))
    assert many > few
    assert D.threshold("x", {"x": 0.7}) == (0.7, None) and D.threshold("y", {"x": 0.7}, 0.6)[0] == 0.6
    shape = "def {n}(v):\n    return v + 1"
    rows = [(1, str(i), i, "function", shape.format(n=n), 9) for i, n in enumerate("ab")]
    df = spark.createDataFrame(rows, "doc_id bigint, id string, ord int, kind string, text string, token_count int").withColumns({x: F.lit(None).cast("string") for x in ("template", "symbol", "level")})
    assert D.deduplicate(df).where("leader is not null").count() == 0 and D.deduplicate(df, min_shape_tokens=5).where("leader is not null").count() == 1


def test_judge_is_asked_no_more_after_failures():
    calls = []

    def ask(answer):
        calls.append(answer)
        return {"yes": 'so {"correct": true}', "no": '{"correct": false}', "odd": "{not json}"}.get(answer)

    assert V.judged(["yes", "no", "odd", "", None, "yes"], ask) == [True, False, None, None, None, True]
    calls.clear()
    assert V.judged(["x", "yes", "x", "x", "x", "yes"], ask) == [None, True, None, None, None, None] and calls == ["x", "yes", "x", "x", "x"]


def test_a_cut_original_is_an_error(spark):
    items = spark.createDataFrame([("a", 10), ("b", 20_000)], "id string, original_tokens int")
    assert V.guard_window(items, local=False).count() == 2 and V.guard_window(items.where("id = 'a'"), local=True).collect()[0]["original_tokens"] == 10
    with pytest.raises(Exception, match="b: 20000 tokens"):
        V.guard_window(items, local=True).collect()


def test_chains_embed_and_rewrite(spark):
    def quota(*_):
        raise ValueError("quota")

    sizes = []

    def local(texts):
        sizes.append(len(texts))
        return E.hashing_embedder(8)(texts)

    rows = docs(spark, ("a", "one two"), ("b", "three"))
    found = E.embed(rows, E.Chain([("openai", True, quota), ("local", True, local)])).collect()
    assert all(len(r["vector"]) == 8 for r in found) and sizes == [1]
    with pytest.raises(RuntimeError, match="openai: failed quota"):
        E.embed(rows, E.Chain([("openai", True, quota)]))
    text = " ".join(["plain"] * 200)
    chunk = [(1, "a", 0, "paragraph", text, 260, True, None)]
    df = spark.createDataFrame(chunk, "doc_id bigint, id string, ord int, kind string, text string, token_count int, selected boolean, symbol string")
    chain = E.Chain([("groq", True, quota), ("local", True, lambda t, seconds: " ".join(t.split()[:190]))])
    out, judged, why = A.rewrite(df, chain, overlap=0.5)
    assert why is None and out.first()["compressed_text"] is not None and judged.count() == 1
    assert A.rewrite(df, E.Chain([("groq", False, quota)]))[2] == "no model is available"


def test_largest_clusters_and_protected_questions(spark):
    found = spark.createDataFrame([(1, i, n) for i, n in enumerate((2, 5, 5, 3))], "doc_id bigint, cluster_id int, size int")
    assert [(r["cluster_id"], r["place"]) for r in D.largest_clusters(found, 3).orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3)]
    chunks = C.chunk(docs(spark, ("a.md", "Some words to keep."), ("b.md", "Other words to keep.")))
    asks = spark.createDataFrame([(0, "why?"), (1, " ")], "doc_id bigint, query string")
    rows = {(r["doc_id"], r["ord"]): r["kind"] for r in ingest.with_protected(chunks, asks).collect()}
    assert rows == {(0, 0): "query", (0, 1): "paragraph", (1, 0): "paragraph"}
    assert ingest.with_protected(chunks) is chunks
