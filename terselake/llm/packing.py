"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Map-only: each task packs its own stream in groups of about ``group_tokens`` tokens, so nothing is
shuffled and memory is bounded by a group. Within a group the number of sequences is the least that can
hold the tokens. Documents go in descending length to the sequence of lowest estimated cost
(``linear * n + quadratic * n**2`` summed over its pieces) that still has room; what fits nowhere whole is
cut over the sequences with most room. A group therefore pads less than one sequence in all.

Tokens: white space between words yields none, so a document's ids are those of its words one after
another. Arrow splits a stretch of documents and numbers its distinct words; only words not met before are
encoded, and ids are gathered by word number, so Python never handles a word twice in a stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
#: Words a task remembers, and bytes of text it splits at once.
CACHE = 300_000
STRETCH = 2 << 20
#: A word-level tokenizer that lower-cases composed text and cuts before a mark that follows a letter or number.
LOWERING = r"Sequence\(normalizers=\[NFC\(\), Replace\(.*\), Lowercase\(\)\]\)$"
CUTTING = r"Sequence\(pretokenizers=\[Split\(.*\), ByteLevel\(add_prefix_space=False, trim_offsets=True, use_regex=False\)\]\)$"
_MARK = r"""([\pL\pN])([!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~])"""
_tokenizers: dict[str | None, WordIds] = {}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Numbers words, and holds the ids of each; when full, forgets those it met last, the rarer ones."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.plain = all(re.match(p, repr(x)) for p, x in ((LOWERING, tokenizer.normalizer), (CUTTING, tokenizer.pre_tokenizer)))
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. One of Latin letters only is one piece, which the merges get as it is."""
        out, other = [], []
        for w in words:
            low = w.lower() if self.plain and w.isalpha() and max(w) < "\u0250" else ""
            if low.isalpha():
                out.append([t.id for t in self.tokenizer.model.tokenize(low.encode().decode("latin-1").translate(self.letters))])
            else:
                other.append(len(out))
                out.append([])
        for k, e in zip(other, self.tokenizer.encode_batch([words[k] for k in other], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each of ``words``, which are distinct; others may be forgotten for them."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > CACHE:
            keep = list(self.number)[: CACHE // 2]
            self.number = dict(zip(keep, range(len(keep)), strict=True))
            self.start = self.start[: len(keep) + 1].copy()
            self.flat = self.flat[: self.start[-1]].copy()
            new = [w for w in words if w not in self.number]
        if new:
            found = self.encode(new)
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.flat = np.concatenate((self.flat, np.array([i for ids in found for i in ids], "<u4")))
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(size)))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def word_ids(path: str | None) -> WordIds:
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            _tokenizers[path] = WordIds(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
        else:
            _tokenizers[path] = WordIds(Tokenizer.from_file(path))
    return _tokenizers[path]


def tokenise(texts: pa.Array, ids: WordIds, end: int) -> Iterator[np.ndarray]:
    """The ids of each text, with ``end`` after them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edge = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // STRETCH
    cuts = [0, *(np.flatnonzero(np.diff(edge)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = texts[a:b]
        if ids.plain:  # a space where the tokenizer cuts anyway makes fewer words
            if not pc.any(pc.match_substring(part, "<|")).as_py():  # special tokens are matched as written
                part = pc.ascii_lower(part)
            part = pc.replace_substring_regex(part, _MARK, r"\1 \2")
        # Only these four are split at: any other white space is the tokenizer's business.
        for c in "\n\t\r":
            part = pc.replace_substring(part, c, " ")
        part = pc.split_pattern(part, " ")
        words = part.flatten().dictionary_encode()
        number = ids.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        first, size = ids.start[number], ids.start[number + 1] - ids.start[number]
        before = np.concatenate(([0], np.cumsum(size)))
        flat = ids.flat[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        at = before[part.offsets.to_numpy() - part.offsets[0].as_py()]
        for i, j in zip(at.tolist(), at[1:].tolist(), strict=False):
            yield np.append(flat[i:j], np.uint32(end))


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float):
    """Yields (document, start, length, sequence, offset, sequence cost so far) for one group."""
    whole = [n // capacity for n in lengths]
    rest = np.array([n % capacity for n in lengths], np.int64)
    bins = int(-(-rest.sum() // capacity))
    room, cost, used = np.full(bins, capacity, np.int64), np.zeros(bins), np.zeros(bins, np.int64)

    def put(doc: int, start: int, length: int, b: int):
        at = int(used[b])
        used[b] += length
        room[b] -= length
        cost[b] += linear * length + quadratic * length * length
        return doc, start, length, b, at, float(cost[b])

    left = []
    for d in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[d])
        if not n:
            break
        fits = np.where(room >= n, cost, np.inf)
        b = int(fits.argmin())
        if np.isinf(fits[b]):
            left.append(d)
        else:
            yield put(d, whole[d] * capacity, n, b)
    for d in left:
        start, n = whole[d] * capacity, int(rest[d])
        while n:
            b = int(room.argmax())
            take = min(n, int(room[b]))
            yield put(d, start, take, b)
            start, n = start + take, n - take
    b = bins
    for d, k in enumerate(whole):
        for i in range(k):
            yield d, i * capacity, capacity, b, 0, linear * capacity + quadratic * capacity * capacity
            b += 1


def pack(
    docs: DataFrame,
    *,
    tokenizer_path: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    group_tokens: int = 1 << 20,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
) -> DataFrame:
    """Packs ``docs`` (doc_id, text; other columns ignored) and returns a row per piece.

    ``ids`` holds the piece's ids, little-endian unsigned 32-bit. A null or empty text is just the end
    id; null doc_ids and repeated rows are packed as documents of their own; an empty table gives no
    rows. ``sequence_id`` is unique over the table: the task's number and a counter. ``tokenizer_path``
    None means the word-level file of the installed public tokenizers, found on each executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, base, sequences = word_ids(tokenizer_path), TaskContext.get().partitionId() << 36, 0
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal sequences, tokens
            cols: list[list] = [[] for _ in range(8)]
            most = -1
            for d, start, length, b, offset, cost in balance(
                [len(x) for _, x in held], capacity, linear, quadratic
            ):
                doc_id, x = held[d]
                row = (doc_id, start, length, x[start : start + length].tobytes(), len(x), base + sequences + b, offset, cost)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                most = max(most, b)
            sequences += most + 1
            tokens = 0
            held.clear()
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.float64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cost"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), tokenise(batch.column(1), ids, end_id), strict=True):
                held.append((doc_id, x))
                tokens += len(x)
                if tokens >= group_tokens:
                    yield flush()
        if held:
            yield flush()
        ids.clear()  # the worker's memory is the next task's, of whatever kind
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
