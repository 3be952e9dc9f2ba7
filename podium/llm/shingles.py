"""Word shingles as 64-bit hashes, of columns of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from podium.llm.hashes import BASE, LOWER, mixed, of_stretches, sums
from podium.llm.tokens import slices

#: Bytes of text that are worked on at once.
SLICE_BYTES = 300_000
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in a row, and where each begins (one more entry than texts)."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII letters in lower case, between ASCII white space) in a row, and where each text's begin."""
    data, bounds = bytes_of(column)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    word = ~_BLANK[data]
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    begin = np.flatnonzero(word & (~before | edge[:-1]))
    behind = np.zeros(len(data), bool)
    behind[:-1] = word[1:]
    end = np.flatnonzero(word & (~behind | edge[1:])) + 1
    return of_stretches(sums(data, LOWER), begin, end), np.searchsorted(begin, bounds)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles of `size` words, sorted; with fewer words the whole sequence is one, without words there is none."""
    hashes, bounds = word_hashes(column)
    factors = [np.uint64(pow(BASE, k + 1, 1 << 64)) for k in range(size)]  # odd, so that every word counts with all its bits
    with np.errstate(over="ignore"):
        many = max(0, len(hashes) - size + 1)
        runs = np.zeros(many, np.uint64)
        for k in range(size):
            runs += hashes[k : k + many] * factors[k]
        runs = mixed(runs)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            elif b > a:
                x = np.array([b - a], np.uint64)
                for k in range(a, b):
                    x += hashes[k] * factors[k - a]
                out.append(mixed(mixed(x)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def batches_of_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch (a null text is empty) with its texts' sets."""
    for batch in slices(batches, most=SLICE_BYTES):
        yield batch, shingle_sets(pc.fill_null(batch.column("text"), ""), size)
