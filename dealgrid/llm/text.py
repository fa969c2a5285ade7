"""Vectorised words and word shingles of Arrow text columns (numpy, inside tasks).

A word is a run of characters other than ``\\x20`` and ``\\x09-\\x0D``; A-Z are
lower-cased.  Both rules act on single bytes of the UTF-8 form, so whole Arrow
buffers are processed at once, about ``CHUNK`` bytes at a time: memory in a task
follows the chunk (or the longest single text), never the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SHINGLE = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
# One random value for each byte, 0 for separators; folded: A-Z as a-z.
_CASED = _rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
_CASED[_SPACE] = 0
_BYTE = _CASED.copy()
_BYTE[65:91] = _BYTE[97:123]
# Terms: runs of ASCII letters and digits and of bytes beyond ASCII.
_NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_TERM = _BYTE.copy()
_TERM[_NOT_TERM] = 0
_RULES = {"folded": (_SPACE, _BYTE), "cased": (_SPACE, _CASED), "terms": (_NOT_TERM, _TERM)}
_PLACE = _rng.integers(1, 1 << 63, size=8, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (in a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Local(dict):
    """Kept by one process: functions that use it travel to tasks with an empty one."""

    def __reduce__(self):
        return type(self), ()


_POWERS: dict[str, np.ndarray] = _Local()


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK + 1:  # one long text: not kept
        return _powers(_BASE, n), _powers(_BASE_INV, n)
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, CHUNK + 1), _powers(_BASE_INV, CHUNK + 1)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def spans(offsets: np.ndarray, limit: int = CHUNK):
    """Ranges [lo, hi) of rows whose texts take about ``limit`` bytes (one row at least)."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _hashes(raw: np.ndarray, starts_at: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of ``raw``; texts begin at ``starts_at``."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    separator, value = _RULES[rule]
    gap = separator[raw]
    begin = np.empty(len(raw), dtype=bool)
    begin[0] = True
    begin[1:] = gap[:-1]
    begin[starts_at[starts_at < len(raw)]] = True
    begin &= ~gap
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _tables(len(raw))
    part = value[raw]
    part *= up[:len(raw)]
    h = np.add.reduceat(part, starts)
    h *= down[starts]
    return starts, mix64(h)


def _pieces(raw: np.ndarray):
    """A long text cut at separators into pieces of about CHUNK bytes."""
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw):
            gap = np.flatnonzero(_SPACE[raw[end:end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + CHUNK, len(raw))
        yield at, end
        at = end


def word_hashes(column, rule: str = "folded"):
    """Yields (lo, hi, hashes, counts): the word hashes of rows lo..hi-1, in order,
    and the number of words of each of these rows.  rule: "folded" (A-Z as a-z),
    "cased", or "terms" (folded runs without ASCII punctuation)."""
    raw, offsets = text_buffer(column)
    for lo, hi in spans(offsets):
        part, off = raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        if hi - lo == 1 and len(part) > 2 * CHUNK:
            hashes = np.concatenate([_hashes(part[a:b], np.zeros(1, np.int64), rule)[1] for a, b in _pieces(part)])
            yield lo, hi, hashes, np.array([len(hashes)])
            continue
        starts, hashes = _hashes(part, off[:-1], rule)
        yield lo, hi, hashes, np.diff(np.searchsorted(starts, off))


def windows(hashes: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, number per row): hashes of all runs of ``width`` words inside a row;
    a row with fewer words, but any, has one: its whole sequence."""
    ends = np.cumsum(counts)
    n = len(hashes)
    number = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    if n == 0:
        return np.zeros(0, np.uint64), number
    total = np.zeros(n, dtype=np.uint64)
    for j in range(min(width, n)):
        total[:n - j] += hashes[j:] * _PLACE[j]
    keep = np.zeros(n + 1, dtype=np.int32)  # +1 at the first, -1 after the last window of a row
    firsts = ends - counts
    full = counts >= width
    np.add.at(keep, firsts[full], 1)
    np.add.at(keep, firsts[full] + number[full], -1)
    keep = np.cumsum(keep[:-1]).astype(bool)
    short = np.flatnonzero((counts > 0) & ~full)
    for r in short:
        a, c = int(firsts[r]), int(counts[r])
        whole = np.uint64(c)
        with np.errstate(over="ignore"):
            for j in range(c):
                whole = whole * np.uint64(0x9FB21C651E98DF25) + hashes[a + j] * _PLACE[j]
        total[a] = whole
        keep[a] = True
    return mix64(total[keep]), number


def shingle_sets(column, width: int = SHINGLE):
    """Yields (row, sorted distinct shingle hashes) for every row of the column."""
    for lo, hi, hashes, counts in word_hashes(column):
        shingles, number = windows(hashes, counts, width)
        at = 0
        for i, k in enumerate(number.tolist()):
            s = np.sort(shingles[at:at + k])
            at += k
            if k > 1:
                first = np.empty(k, dtype=bool)
                first[0] = True
                np.not_equal(s[1:], s[:-1], out=first[1:])
                s = s[first]
            yield lo + i, s
