"""Runs of code points that are equal, found without a string per run."""

from __future__ import annotations

import ctypes

import numpy as np

_BASE = 0x9E3779B97F4A7C15


#: Words longer than this many blocks of 8 bytes are named one by one.
_BLOCKS = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_names(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit name of each run of bytes data[begin : stop], equal for equal runs.

    Every 8 bytes are scrambled together with their place in the run before they are
    summed, so that no exchange of parts keeps the sum.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    length = stop - begin
    salt = mixed(np.array([seed], np.uint64) + np.uint64(_BASE))
    out = mixed(length.astype(np.uint64) + salt)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def part(block: np.ndarray, place) -> np.ndarray:
        return mixed(mixed(block + salt) ^ mixed((np.asarray(place, np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))

    own = np.flatnonzero(length > 0)
    for i in range(_BLOCKS):
        if not len(own):
            return mixed(out)
        left = length[own] - 8 * i
        out[own] += part(view[begin[own] + 8 * i] & masks[np.minimum(left, 8)], [i])
        own = own[left > 8]
    for k in own.tolist():
        at = np.arange(begin[k] + 8 * _BLOCKS, stop[k], 8)
        out[[k]] += part(view[at] & masks[np.minimum(stop[k] - at, 8)], np.arange(_BLOCKS, _BLOCKS + len(at))).sum(keepdims=True, dtype=np.uint64)
    return mixed(out)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** n modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: workers outlive their tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def _alike(points: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
    """Whether the runs of points at a and at b are equal, each of its length."""
    differ = a != b
    a, b, n = a[differ], b[differ], length[differ]
    for i in range(0, len(a), 1 << 18):
        c = n[i : i + (1 << 18)]
        inside = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        if (points[np.repeat(a[i : i + (1 << 18)], c) + inside] != points[np.repeat(b[i : i + (1 << 18)], c) + inside]).any():
            return False
    return True


def distinct(points: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, same): a run of each distinct kind, and the kind of every run, points[begin : stop] each.

    Runs meet by a hash; every run is then held against the first of its kind, point
    by point. Should two kinds share a hash, every run is a kind of its own.
    """
    power, inverse = powers(_BASE, len(points)), powers(pow(_BASE, -1, 1 << 64), len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(7)) * power[:-1], out=sums[1:])
    length = stop - begin
    names = (sums[stop] - sums[begin]) * inverse[begin]
    names = (names ^ names >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) ^ length.astype(np.uint64)
    _, first, same = np.unique(names, return_index=True, return_inverse=True)
    if (length != length[first][same]).any() or not _alike(points, begin, begin[first][same], length):
        first = same = np.arange(len(begin))
    return first, same


def runs_alike(points: np.ndarray, begin: np.ndarray, stop: np.ndarray, first: np.ndarray) -> bool:
    """Whether every run points[begin : stop] equals the run with the number ``first`` beside it."""
    length = stop - begin
    return bool((length == length[first]).all()) and _alike(points, begin, begin[first], length)
