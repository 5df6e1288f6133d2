"""Words of whole texts as 64-bit hashes, in numpy: what the word-window operators share.

A word is a maximal run of bytes other than space and ``\\x09-\\x0D``; this splits UTF-8 text as it splits characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed at once; bounds the working memory, whatever the texts' lengths.
SLICE = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        size = max(n, SLICE)
        up, down = np.full(size, BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; nulls are empty."""
    column = column.cast(pa.string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, target: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``target`` bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + target, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the documents cut at ``at`` (whose first entry is where data begins)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = at[1:-1] - at[0]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[1:-1][cuts]
    ends[cuts - 1] |= inside[1:-1][cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, side="right")))
        lo = starts[i]
        seg = data[lo : ends[j - 1]]
        up, down = _powers(len(seg) + 1)
        total = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * up[: len(seg)], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mixed((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row (across documents too: the caller drops those)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[j : j + m]
    return mixed(out)
