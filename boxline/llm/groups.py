"""Rows of one key at a time, from partitions that are sorted by the key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal ``keys`` in a row. Only the group at hand and one batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
        start = 0
        for i, name in enumerate(names):
            if name == last:
                continue
            if last is not None:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held = []
            start, last = i, name
        if len(names) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
