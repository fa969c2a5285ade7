"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (operator 1).

An item of ``n`` shingles counts as leaked where a document's item-sized window (``n``
shingles in a row) has a weighted similarity of ``num/den`` or more with it: shingles count
as often as they occur, sum of minima over sum of maxima.  Such a window lost at most
``n (den - num) / (den + num)`` of the item's shingles.  A changed word inside a passage takes
four shingles or more, so an untouched run of known length ``L`` is left (``untouched``).
The SimHash windows are sized by the item: classes of L in powers of two, windows of half a
class, so that any run of L shingles in a document holds a whole window of the grid that
is probed.  Items give a fingerprint for every offset.

Fingerprints are looked up by four 16-bit blocks, each also under its 16 neighbours with one
bit changed: two fingerprints within 7 bits agree in a block up to one bit (pigeonhole), so
*every* pair within the radius is found; the distance is then computed, and what is left is
verified exactly: every item-sized window that contains the shared run, wherever in the
window the item has it, since similarity does not ask for order and parts may be swapped.

All of a document's windows are in its own task and the items are broadcast in blocks of
bounded size, so documents are never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealgrid.llm.common import in_tasks, text_only
from dealgrid.llm.text import shingle_sets, windows, word_hashes  # noqa: F401

RADIUS = 7              # guaranteed by 4 blocks of 16 bits with one bit changed
BLOCK_SHINGLES = 1 << 20  # item shingles in one broadcast (about 60 MB with the tables)
_ONE = (1 << np.arange(16)).astype(np.int64)


def untouched(n: int, num: int, den: int) -> int:
    """Shingles in a row that an item of n shingles must share with a window that matches,
    be it of n shingles or cut by the text's ends."""
    def run(size: int) -> int:
        both = -(-num * (n + size) // (num + den))
        return -(-both // ((size - both) // 4 + 1))
    return max(1, min(run(size) for size in range(-(-n * num // den), n + 1)))


def window_class(n: int, num: int, den: int) -> tuple[int, int]:
    """(width, stride) in shingles of the SimHash windows for items of n shingles."""
    run = 1 << (untouched(n, num, den).bit_length() - 1)
    width = max(1, run // 2)
    return width, run - width + 1


def fingerprints(bits: np.ndarray, starts: slice, width: int, count: int, stride: int) -> np.ndarray:
    """SimHash of ``count`` windows: the majority of each bit over ``width`` shingles."""
    votes = np.zeros((count, 64), dtype=np.uint16 if width > 255 else np.uint8)
    for t in range(width):
        at = starts.start + t
        votes += bits[at:at + stride * (count - 1) + 1:stride]
    return np.packbits(votes > width // 2, axis=1).view(np.uint64).ravel()


def shingle_bits(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1)


class ItemIndex:
    """Multi-index tables over the fingerprints of a block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], num: int, den: int):
        self.num, self.den = num, den
        self.ids = [i for i, _ in items]
        self.shingles = [s for _, s in items]
        self.counted = [np.unique(s, return_counts=True) for s in self.shingles]
        by_class: dict[tuple[int, int], list[int]] = {}
        for k, s in enumerate(self.shingles):
            by_class.setdefault(window_class(len(s), num, den), []).append(k)
        self.classes = []
        self.widths = [window_class(len(s), num, den)[0] for s in self.shingles]
        for (width, stride), members in sorted(by_class.items()):
            fps, item = [], []
            for k in members:
                count = len(self.shingles[k]) - width + 1
                fps.append(fingerprints(shingle_bits(self.shingles[k]), slice(0, None), width, count, 1))
                item.append(np.full(count, k))
            fps, item = (np.concatenate(x) for x in (fps, item))
            tables = []
            for b in range(4):
                value = ((fps >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                near = np.concatenate([value, *[value ^ x for x in _ONE]])
                entry = np.tile(np.arange(len(fps)), 17)
                order = np.argsort(near, kind="stable")
                starts = np.searchsorted(near[order], np.arange(65537))
                tables.append((starts, entry[order]))
            self.classes.append((width, stride, fps, item, tables))

    def candidates(self, bits: np.ndarray, row: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(item, first shingle) of all windows of the grid within the radius of one of the item.
        row: the text of each shingle; windows stay inside one text."""
        out = []
        n = len(row)
        for width, stride, fps, item, tables in self.classes:
            count = (n - width) // stride + 1 if n >= width else 0
            if not count:
                continue
            at = np.arange(count) * stride
            got = fingerprints(bits, slice(0, None), width, count, stride)
            inside = row[at] == row[at + width - 1]
            at, got = at[inside], got[inside]
            for b, (starts, entry) in enumerate(tables):
                value = ((got >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
                first, size = starts[value], starts[value + 1] - starts[value]
                which = np.repeat(np.arange(len(got)), size)
                if not len(which):
                    continue
                shift = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                e = entry[first[which] + shift]
                near = np.bitwise_count(got[which] ^ fps[e]) <= RADIUS
                which, e = which[near], e[near]
                if len(e):
                    out.append((item[e], at[which]))
        return out

    def similarities(self, k: int, text: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, weighted Jaccard similarity) of item k and the item-sized windows that
        begin at first..last, cut at the text's ends.

        A shingle counts in a window if it is among the first there of as many equals as the
        item has; it does so for the windows that begin after the equal shingle which is that
        many back, so one running sum gives all windows."""
        own, own_n = self.counted[k]
        n = len(self.shingles[k])
        lo, hi = max(first, 0), min(last + n, len(text))
        part = text[lo:hi]
        at = np.minimum(np.searchsorted(own, part), len(own) - 1)
        mine = np.flatnonzero(own[at] == part)
        mine = mine[np.argsort(at[mine], kind="stable")]
        which = at[mine]
        back = np.arange(len(mine)) - own_n[which]
        there = (back >= 0) & (which[back] == which)
        place = mine + lo
        since = np.where(there, place[back] + 1, first)
        since, until = np.maximum(np.maximum(since, place - n + 1), first), np.minimum(place, last) + 1
        counts = since < until
        steps = np.zeros(last - first + 2, dtype=np.int64)
        np.add.at(steps, since[counts] - first, 1)
        np.add.at(steps, until[counts] - first, -1)
        both = np.cumsum(steps[:-1])
        start = np.arange(first, last + 1)
        begin, end = np.maximum(start, 0), np.minimum(start + n, len(text))
        return begin, end, both / (n + end - begin - both)

    def matches(self, shingles: np.ndarray, row: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple[float, int]]:
        """(text, item) -> (best similarity, shingle of the text where that window begins)."""
        found: dict[tuple[int, int], tuple[float, int]] = {}
        pairs = self.candidates(shingle_bits(shingles), row) if len(shingles) else []
        if not pairs:
            return found
        items, seeds = (np.concatenate(x) for x in zip(*pairs))
        seen = np.unique(np.stack([row[seeds], items, seeds]), axis=1)
        new = np.any(seen[:2, 1:] != seen[:2, :-1], axis=0)
        # Seeds of a text and item less than an item apart: their windows are one range.
        apart = seen[2, 1:] - seen[2, :-1] >= np.array([len(x) for x in self.shingles])[seen[1, 1:]]
        cut = np.concatenate(([0], np.flatnonzero(new | apart) + 1, [seen.shape[1]]))
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            r, k = int(seen[0, x]), int(seen[1, x])
            n, lo = len(self.shingles[k]), int(ends[r - 1]) if r else 0
            first, last = int(seen[2, x]) - lo + self.widths[k] - n, int(seen[2, y - 1]) - lo
            begin, end, sim = self.similarities(k, shingles[lo:int(ends[r])], first, last)
            sim[(end - begin < n * self.num // self.den) | (sim * self.den < self.num)] = 0
            top = int(np.argmax(sim))
            best = found.get((r, k), (0.0, 0))
            if sim[top] > best[0]:  # ranges come in order: the first of equals stays
                found[r, k] = (float(sim[top]), int(begin[top]))
        return found


def item_blocks(items: DataFrame, num: int, den: int, width: int) -> list[ItemIndex]:
    """The benchmark in blocks of bounded size (its own size bounds the driver, in blocks)."""
    out, block, size = [], [], 0
    src = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for i, text in src.orderBy("item_id", "text").toLocalIterator():
        _, _, hashes, counts = next(word_hashes(pa.array([text])))
        s, _ = windows(hashes, counts, width)
        if len(s):
            block.append((i, s))
            size += len(s)
        if size >= BLOCK_SHINGLES:
            out.append(ItemIndex(block, num, den))
            block, size = [], 0
    return out + ([ItemIndex(block, num, den)] if block else [])


def _found(column, index: ItemIndex, width: int):
    """Yields (row, item, similarity, first shingle) of a text column."""
    for lo, _, hashes, counts in word_hashes(column):
        shingles, number = windows(hashes, counts, width)
        row = np.repeat(np.arange(len(number)), number)
        for (r, k), (sim, at) in sorted(index.matches(shingles, row, np.cumsum(number)).items()):
            yield lo + r, k, sim, at


def leaks(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): benchmark items in documents.

    One row for each input row of ``docs`` and item that it holds: the most similar
    item-sized window (the first of equals).  ``items`` has item_id and text.  Items without
    an id or a word are passed over; an item of fewer than ``width`` words matches only a text
    that is the same words.  Null and empty texts hold nothing; null doc_ids and repeated
    rows are kept as they come; empty tables give no rows; extra columns are ignored.
    """
    spark, src = docs.sparkSession, text_only(docs)
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    out = spark.createDataFrame([], schema)
    for index in item_blocks(items, num, den, width):
        shared = in_tasks(spark, index)

        def run(batches, shared=shared):
            index = shared()
            for batch in batches:
                rows = [(batch.column(0)[r].as_py(), index.ids[k], sim, at, len(index.shingles[k]) + width - 1)
                        for r, k, sim, at in _found(batch.column(1), index, width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()])],
                    ["doc_id", "item_id", "similarity", "start_word", "n_words"])
        out = out.unionByName(src.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (all columns, text among them) without the rows that hold an item."""
    out, text_at = docs, docs.columns.index("text")
    for index in item_blocks(items, num, den, width):
        shared = in_tasks(docs.sparkSession, index)

        def run(batches, shared=shared):
            index = shared()
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r for r, *_ in _found(batch.column(text_at), index, width)]] = False
                yield batch.filter(pa.array(keep))
        out = out.mapInArrow(run, docs.schema)
    return out
