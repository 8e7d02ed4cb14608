"""Words of whole Arrow string columns as numpy arrays, without a Python step for each row."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P, _SEED = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
_PINV = U(pow(int(_P), -1, 1 << 64))
#: Bytes that are hashed at once; only the temporaries depend on it.
CHUNK = 1 << 19
_powers: dict[str, np.ndarray] = {}


try:  # glibc: arrays of four megabytes or more go back to the system when they are dropped
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.mallopt(-3, 4 << 20)
    _LIBC.malloc_trim
except (OSError, AttributeError):
    _LIBC = None


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def releasing(task):
    """A task over batches that gives its memory back at its end; Python workers outlive tasks."""

    @functools.wraps(task)
    def run(batches):
        from typeloom.llm import _text  # the module is not sent along

        yield from task(batches)
        _text.release()

    return run


def _table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = _table(lambda b: b not in b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased
ALNUM = _table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_powers.get("p", ())) < n:
        for k, base in (("p", _P), ("q", _PINV)):
            a = np.full(n, base, U)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=U)
    return _powers["p"][:n], _powers["q"][:n]


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, size: int, rows: int = 1 << 30):
    """Ranges of at most ``rows`` documents and about ``size`` bytes; a longer document is a range of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1), i + rows)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offs: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 offsets of each document's words among them.

    A word is a run of bytes in ``kept``; it never crosses a document's end.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = kept[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        part = data[base : ends[j - 1]]
        p, q = powers(max(CHUNK, len(part)) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum((LOWER[part] if lower else part).astype(U) * p[: len(part)] + p[: len(part)], dtype=U, out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[b] - total[a]) * q[a] ^ ((b - a).astype(U) * _SEED))
        i = j
    return out


def owner(offs: np.ndarray) -> np.ndarray:
    """For each item its document, from the documents' n + 1 offsets among the items."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def shingles(h: np.ndarray, woffs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and their documents, in order; fewer words, but some, are one run."""
    n = np.diff(woffs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    doc = np.repeat(np.arange(len(n)), count)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + woffs[:-1][doc]
    out = np.zeros(len(doc), U)
    left = n[doc]
    for j in range(k):
        ok = left > j if len(h) else np.zeros(0, bool)
        at = np.minimum(begin + j, max(len(h) - 1, 0))
        part = mix(h[at] + U((j + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)) if len(h) else out
        out += np.where(ok, part, U(j + 1))
    return mix(out), doc
