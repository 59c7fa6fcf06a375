"""Arrays of numbers as one compressed block, and rows that lie together by a key in sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_KINDS = ("|u1", "<u2", "<u4", "<u8", "<i8")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block. Bytes of equal significance lie together, so small numbers take little room."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), _KINDS.index(a.dtype.str)))], dtype="<i8")
    raw = head.tobytes() + b"".join(a.tobytes() if a.itemsize == 1 else np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, "<i8", 1)[0]), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for size, kind in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        width = np.dtype(_KINDS[kind]).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at)
        out.append(planes if width == 1 else np.ascontiguousarray(planes.reshape(width, size).T).reshape(-1).view(_KINDS[kind]))
        at += size * width
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Numbers of 0 or more in the least width that holds them."""
    top = int(x.max(initial=0))
    return x.astype("|u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")


def by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(first column, other columns) of the rows of each key; batches are sorted by their first column, a long."""
    now, rows = None, []
    for batch in batches:
        for key, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(tuple(rest))
    if rows:
        yield now, rows


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    if len(x):
        edge = np.flatnonzero(x[1:] != x[:-1]) + 1
        yield from zip([0, *edge.tolist()], [*edge.tolist(), len(x)], strict=True)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
