"""Runs of numbers as rows: few large rows are cheap to shuffle, and arrays need no conversion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def blob(columns) -> bytes:
    """A compressed run of equally long columns."""
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def columns_of(blobs: list[bytes], types: tuple) -> list[np.ndarray]:
    """The columns of all runs, one behind the other."""
    width, parts = sum(np.dtype(t).itemsize for t in types), []
    for x in blobs:
        size = int.from_bytes(x[:8], "little")
        raw, at, n, own = pa.decompress(x[8:], size, codec="lz4", asbytes=True), 0, size // width, []
        for t in types:
            own.append(np.frombuffer(raw, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
        parts.append(own)
    return [np.concatenate(c) if parts else np.empty(0, t) for c, t in zip(zip(*parts) if parts else [()] * len(types), types)]


def blob_rows(kind: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """(key, run) as rows of a kind."""
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(rows), pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())],
        names=["kind", "key", "blob"],
    )


BLOBS = "kind int, key int, blob binary"


def grouped(batches: Iterator[pa.RecordBatch], pass_on: bool) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """((kind, key), its blobs) of rows sorted by them; of kind 1 each blob at once with ``pass_on``."""
    now, held = None, []
    for b in batches:
        for kind, key, data in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "blob"))):
            if kind == 1 and pass_on:
                yield (kind, key), [data]
                continue
            if now != (kind, key):
                if held:
                    yield now, held
                now, held = (kind, key), []
            held.append(data)
    if held:
        yield now, held


def dealt(key: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(key, run of its rows) for each key; rows keep their order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.empty(0, np.int64)
    for i, j in zip(cuts, np.r_[cuts[1:], len(key)]):
        own = order[i:j]
        yield int(key[own[0]]), blob([c[own] for c in columns])
