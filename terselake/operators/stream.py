"""Whole documents out of a stream of Arrow batches in which each document's rows stand together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def whole(batches: Iterator[pa.RecordBatch], key: str = "doc_id") -> Iterator[pa.Table]:
    """Tables of one or more whole documents, in the order they come; only a document's own rows wait for its end."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(key).to_pylist()
        start = len(ids) - 1
        while start and ids[start - 1] == ids[-1]:
            start -= 1
        if held and ids[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        if start:
            yield pa.Table.from_batches([*held, b.slice(0, start)])
            held = []
        held.append(b.slice(start))
        last = ids[-1]
    if held:
        yield pa.Table.from_batches(held)
