"""Bounded slices of Arrow batches for Python stages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text that one slice holds at most, unless a single text is longer.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as UTF-8 bytes; null is empty) in slices of at most SLICE_BYTES of text, or one row."""
    for batch in batches:
        texts = [b"" if x is None else x for x in batch.column(text).cast(pa.binary()).to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > SLICE_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
