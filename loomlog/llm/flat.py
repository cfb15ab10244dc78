"""Text columns as flat byte arrays: words, spans and 64-bit hashes without a Python object each.

Every function works on one Arrow batch inside a Spark task. A null text counts as empty.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker (shipped functions do not)."""
    name = "loomlog_worker_cache"
    return vars(sys.modules.setdefault(name, types.ModuleType(name))).setdefault("held", {})


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_WORD = ~IS_SPACE
# digits, lower-case ASCII letters and everything beyond ASCII
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[0x30:0x3A] = IS_ALNUM[0x61:0x7B] = IS_ALNUM[0x80:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the worker's life."""
    held = worker_cache()
    if "powers" not in held or len(held["powers"][0]) < n:
        size = max(n, PIECE_BYTES + 1)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        held["powers"] = tuple(both)
    return held["powers"]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over the bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    placed = _VALUES[data]
    placed *= _powers(len(data) + 1)[0][: len(data)]
    np.cumsum(placed, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of bytes start..stop that depends on their values only."""
    return mix((sums[stop] - sums[start]) * _powers(len(sums))[1][start])


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence made longer by one element; the order counts."""
    return mix(left * _GOLDEN + right)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
    else:
        column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES):
    """Slices of a batch with about ``limit`` bytes of text each, whole rows always."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes.astype(np.int64)), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_spans(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None):
    """Maximal runs of bytes that are ``inside``, never across rows.

    ``cut`` marks bytes that begin a new run in any case. Returns starts, stops and, for each
    row and the end, the index of its first run.
    """
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if cut is not None:
        edge[:n] |= cut
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.searchsorted(start, offsets)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each run, from the rows' first indexes."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sum_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by row; rows may be empty."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur again anywhere, and is it a repeat of an earlier one?"""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        later[order[1:]] = same
        again[order[1:]] |= same
        again[order[:-1]] |= same
    return again, later


def sorted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit hashes, and the hashes in it.

    Values are sorted several times as fast as places, so a key's place goes into its low bits;
    the few keys that differ in those only are put right afterwards.
    """
    low = np.uint64(len(keys).bit_length())
    packed = (keys >> low) << low
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= (np.uint64(1) << low) - np.uint64(1)
    order = packed.view(np.int64)
    ordered = keys[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong):
        lead = ordered >> low
        among = np.flatnonzero(np.isin(lead, np.unique(lead[wrong])))
        order[among] = order[among][np.argsort(ordered[among], kind="stable")]
        ordered = keys[order]
    return order, ordered


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted hashes, and the number among them of each."""
    order, ordered = sorted_keys(keys)
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    code = np.empty(len(keys), np.int64)
    code[order] = np.cumsum(new) - 1
    return ordered[new], code
