"""Distinct spans of bytes, and the CRC-32 of many spans at once by matrices of spans of equal length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Longest span that goes through a matrix, and the most bytes of one matrix.
MATRIX_WIDTH, MATRIX_BYTES = 1 << 10, 1 << 18


def _steps() -> np.ndarray:
    """For every byte what eight shifts of the reflected polynomial make of it."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


_STEPS = _steps()


def crc32_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The unsigned CRC-32 of each span of `data`, carried on from the CRC `before` it if given.

    Spans of one length are the columns of a matrix with a row for each position, and all their CRCs take one
    position after the other. Spans too long for a matrix are rare and take the same sum one at a time.
    """
    out = np.zeros(len(start), np.uint32) if before is None else before.astype(np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, low, high in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        if size > MATRIX_WIDTH:
            for i in order[low:high].tolist():
                out[i] = zlib.crc32(data[start[i] : start[i] + size], int(out[i]))
            continue
        step = max(1, MATRIX_BYTES // max(size, 1))
        for at in range(low, high, step):
            rows = order[at : min(at + step, high)]
            matrix = data[start[rows] + np.arange(size)[:, None]]
            state = ~out[rows]
            for column in matrix:
                state = _STEPS[state.astype(np.uint8) ^ column] ^ (state >> np.uint32(8))
            out[rows] = ~state
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """For each span (ascending, not overlapping) the number of its distinct value, from 0, and the values."""
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    joined = data[np.arange(bounds[-1]) + np.repeat(start - bounds[:-1], end - start)]
    spans = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(joined)]
    ).dictionary_encode()
    return spans.indices.to_numpy().astype(np.int64), spans.dictionary


def as_bytes(values: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array without nulls, and the bounds of its values in them."""
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds
