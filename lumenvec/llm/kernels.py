"""Numpy kernels over Arrow text columns: word hashes, shingle sets and SuperMinHash signatures."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)
#: ASCII white space: space and \t to \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _MUL)
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64, at least n of them."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS = np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, U(0xD1342543DE82EF95))]))
    return _POWERS


def release() -> None:
    """Give memory that is free in this process back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and n + 1 offsets; null texts are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) else "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 18):
    """Ranges of documents of about so many bytes; a longer document is a range of its own."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that aren't ASCII white space) and the number of words of each document."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = solid[edges]
    last = np.empty_like(solid)
    last[:-1] = solid[:-1] & (~solid[1:] | first[1:])
    last[-1] = solid[-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans that are in order and don't overlap; fold: A-Z as a-z."""
    if len(starts) == 0:
        return np.zeros(0, U)
    lengths = ends - starts
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    local = np.arange(total) - np.repeat(before, lengths)
    at = local + np.repeat(starts, lengths)
    values = (_BYTE_LOWER if fold else _BYTE)[data[at]] * _powers(int(lengths.max()))[local]
    return mix(np.add.reduceat(values, before) + lengths.astype(U) * _MUL)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's word shingles; a shorter text is one shingle, an empty one none."""
    starts, ends, counts = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    out, at = [], 0
    k = U(0x9FB21C651E98DF25)
    if len(words) >= width:
        rolled = words[: len(words) - width + 1].copy()
        for j in range(1, width):
            rolled = rolled * k + words[j : len(words) - width + 1 + j]
        rolled = mix(rolled)
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            h = U(n)
            with np.errstate(over="ignore"):
                for w in words[at : at + n]:
                    h = h * k + w
            out.append(mix(np.array([h ^ U(0x5851F42D4C957F2D)], U)))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def superminhash(sets: list[np.ndarray], m: int = 128, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures, one row for each set; empty sets give rows of the largest value.

    Each element deals itself to the m places in the order of a random permutation of its own, with value rank + u (here rank << 32 | u).
    A place keeps its least value. A set is done, and its elements stop early, once every place holds a value below the next rank.
    """
    sig = np.full((len(sets), m), np.iinfo(U).max, U)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return sig
    x = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = sig.reshape(-1)
    rank, perm = 0, None
    while len(x) and rank < m:
        draw = mix(x + U((seed * 0x9E3779B97F4A7C15 + rank * 0xD6E8FEB86659FD93) % 2**64))
        k = rank + (((draw >> U(32)) * U(m - rank)) >> U(32)).astype(np.int64)
        value = (draw & U(0xFFFFFFFF)) | (U(rank) << U(32))
        if perm is None:
            place = k
        else:
            rows = np.arange(len(x))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, rank]
        np.minimum.at(flat, owner * m + place, value)
        rank += 1
        going = (sig.max(1) >> U(32)) >= U(rank)
        live = going[owner]
        if perm is None and live.any():
            perm = np.broadcast_to(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (int(live.sum()), m)).copy()
            perm[np.arange(len(perm)), k[live]] = 0
        elif not live.all() and perm is not None:
            perm = perm[live]
        x, owner = x[live], owner[live]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    part = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * _MUL), (len(sig), bands)).copy()
    for j in range(rows):
        h = mix(h * U(0x9FB21C651E98DF25) + part[:, :, j])
    return h
