"""Each registered corpus query on small tables against a brute-force version of its whole result."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from terselake.llm import packing
from terselake.llm.queries import QUERIES

RNG = np.random.default_rng(3)
VOCABULARY = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "pa", "Ré") for b in ("ra", "so", "ti", "ve", "xu", "ñe")]


def prose(n):
    return " ".join(str(w) + ("." if RNG.random() < 0.1 else "") for w in RNG.choice(VOCABULARY, n))


ITEM = " ".join(f"exam{i}" for i in range(30))
DOCS = [(i, prose(int(RNG.integers(20, 120)))) for i in range(60)]
DOCS += [(100 + i, DOCS[i % 3][1]) for i in range(30)]  # a third of all rows are copies
DOCS += [(200, None), (201, ""), (202, "one two"), (203, f"{DOCS[9][1]} and more."), (204, f"start {ITEM} end"), (205, "exam3 exam4 " * 30), (206, " ".join(f"tiny{k % 9}" for k in range(5000)))]
BENCH = [(1, ITEM), (2, "exam3-exam4"), (3, None), (10, ITEM + " more")]
PAGES = [(i, f"https://{'abc'[i % 3]}.Example.org/{'es' if i % 2 else 'en'}/{i}?q", f"<article><p>{DOCS[i % 7][1]} &amp; é</p></article>" * (i % 4)) for i in range(40)] + [(50, None, None), (51, "no scheme", "")]
VECTORS = [(i, x.tolist()) for i, x in enumerate(RNG.normal(size=(300, 8)))] + [(400, None), (450, [0.0] * 8)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    tables = {
        "documents": ([(i, t, "en", "s", len(t or "")) for i, t in DOCS], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "benchmark": (BENCH, "item_id bigint, text string"),
        "pages": (PAGES, "page_id bigint, url string, html string"),
        "embeddings": (VECTORS, "vec_id bigint, embedding array<float>"),
        "labels": ([(i, 1, int(i % 5 == 0)) for i, _ in DOCS[:90]], "doc_id bigint, quality int, toxic int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def run(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def low(s):
    return re.sub("[A-Z]", lambda c: c[0].lower(), s or "")


def test_op1(spark, sf):
    tokenizer = packing.word_ids(None).tokenizer
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in run(spark, sf, "op1_pack"):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in DOCS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(sequences) <= total // 2048 + 3  # a task's last group pads less than a sequence


def test_op2(spark, sf):
    got = {r["page_id"]: r for r in run(spark, sf, "op2_link_graph")}
    for i, url, _ in PAGES:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        rule = None if not host else "example.org/es/" if path.startswith("/es/") else "example.org/en/1" if path.startswith("/en/1") else "org/"
        verdict = "allow" if rule in (None, "org/") else "block"
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == (host, path, rule, verdict)


def test_op3(spark, sf):
    got = collections.defaultdict(list)
    for r in run(spark, sf, "op3_adaptive_scan"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = np.array([x for _, x in VECTORS[:300]], np.float32).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 300, 50):
        s = unit @ unit[q]
        s[q] = -2
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        hits += len(set(np.argsort(-s)[:5].tolist()) & {i for _, i, _ in got[q]})
        assert all(x == pytest.approx(s[i], abs=1e-12) for _, i, x in got[q])
    assert set(got) == set(range(0, 300, 50)) and hits >= 27


def test_op4(spark, sf):
    rows = run(spark, sf, "op4_kneser_ney")
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in DOCS)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert all(by[100 + i] == pytest.approx(by[i % 3], abs=1e-9) for i in range(30))


def test_op5(spark, sf):
    got = {r["page_id"]: r for r in run(spark, sf, "op5_line_blocks")}
    for i, url, _ in PAGES:
        text = "\n".join([" ".join(f"{DOCS[i % 7][1]} & é".split())] * (i % 4)) if i < 50 else ""
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, text, len(text))


def test_op6(spark, sf):
    got = {r["page_id"]: r for r in run(spark, sf, "op6_arc_to_warc")}
    first = {}
    for i, _, h in sorted(PAGES):
        data = (h or "").encode()
        to = first.setdefault(data, i) if len(data) >= 100 else i
        want = (len(data), hashlib.sha256(data).hexdigest(), "response" if to == i else "revisit", None if to == i else to)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert len(got) == len(PAGES) and sum(r["record_type"] == "revisit" for r in got.values()) > 5


def test_op7(spark, sf):
    prints = {}
    for i, t in DOCS:
        words = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, sf, "op7_simhash")}
    assert got == {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_op8(spark, sf):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    windows = collections.defaultdict(set)
    for i, t in BENCH:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(i)
    got = {r["doc_id"]: r for r in run(spark, sf, "op8_decontaminate")}
    for i, t in DOCS:
        w, hit, items = words(t), set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == (len(w), len(hit), len(items), digest, bool(hit))
    assert got[204]["n_items"] == 3 and got[205]["n_hit"] == 60


def test_op9(spark, sf):
    rows = run(spark, sf, "op9_shard")
    texts = dict(DOCS)
    counts = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == len(DOCS) and {r["doc_id"] for r in rows} == set(texts)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_op10(spark, sf):
    got = {r["doc_id"]: r for r in run(spark, sf, "op10_line_dedup")}
    texts = dict(DOCS)
    assert len(got) == len(texts)
    for i, t in DOCS:
        if i >= 100 and i < 130:
            assert got[i]["text"] == ("" if len(t.split()) >= 25 else t)
        elif i < 60 or i in (200, 201, 202, 204):
            assert got[i]["text"] == t and got[i]["runs_removed"] == 0
    assert got[203]["text"].split()[-2:] == ["and", "more."] and got[203]["words_removed"] >= 0.7 * len(texts[9].split())
