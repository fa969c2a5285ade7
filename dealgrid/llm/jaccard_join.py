"""N-gram Jaccard join by parity sketches (operator 4).

A document's set are its distinct 5-word shingles.  Its *parity sketch* has ``m`` blocks;
every shingle flips one bit of one block, and a block is folded into a 64-bit value by
XOR.  A shingle that two sets share flips the same bit in both, so the number of blocks
that differ is at most the size of the symmetric difference: a Hamming distance that
bounds it from below.  Sets with a Jaccard similarity of ``num/den`` or more and sizes
a <= b differ in at most ``d = (a + b) * (den - num) / (den + num)`` shingles, and
b <= a * den / num.  Of the ``N`` blocks that hold anything, at least ``N - d`` agree with
the partner's: any ``d + 1`` of them, taken in an order that depends on the block's
content alone, must meet the partner's ``d + 1`` (pigeonhole).  The order puts blocks
with many shingles first, which are the most selective, and *common* keys, which over
``PART`` sets hold, last: a passage that a third of all documents share then gives no key
to documents that have enough text of their own.

Sets are joined per size band [2^k, 2^(k+1)) of the smaller one, with ``m`` fixed in a
band; a set just above a band's upper end is joined in the band below too.  Below
``PLAIN`` shingles each shingle is a block of its own, so that N > d always.  Above it the
expected N lies 8 standard deviations or more over d by the size of ``m``; a set that fails
all the same would stop the job with an error, never lose a link silently.

Steps (all shared state is written to the shared folder):

1. one row per document: set size, 128-bit set identity, dense parity sketch; equal sets
   become one class, so copies never meet each other again;
2. the common keys, counted over all sets (at most ``COMMON``; any order of the keys keeps
   the guarantee, so the list decides only about work);
3. the block keys of each class, grouped by key; keys held by one class are dropped.  Rows
   of common keys are dealt by key and class, so that no task holds a hot bucket;
4. star: each class with the smallest class of its bucket, then components;
5. of buckets that still hold several components, all pairs across components are compared
   by their dense sketches; buckets of more than ``PART`` classes are cut into parts that are
   compared part by part in different tasks, and the largest component's parts meet only
   parts of the others.  A task hands out a spanning forest of the close pairs, the nearest
   first: fewer rows than classes, however many pairs are close;
6. these are verified on the whole shingle sets, and their components joined.  In groups
   where one of them is no link, all close pairs that are still in different components are
   verified; in the others the links have joined all that is close.

A pair is skipped only if its classes are in one component already, so no link is lost.
Classes are named by 64 bits of their identity; the few sets that share them (one pair is
expected at six billion sets) are named by the other 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealgrid.llm.common import small_side, text_only, written
from dealgrid.llm.components import components
from dealgrid.llm.text import mix64, shingle_sets

PLAIN = 64      # below this size every shingle is a block of its own
LOAD = 1.0      # blocks of a band over its lower size limit
PART = 1024     # classes of a bucket that are compared in one task
COMMON = 1_000_000  # most common keys that are set back (8 MB)
SOME = 4        # sets of one chunk of a task that must hold a key before it is counted

_C1, _C2, _C3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3))


def _blocks(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, XOR value, shingles) of the blocks in use, of sorted shingles."""
    block = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return block[first], np.bitwise_xor.reduceat(mix64(s ^ _C1), first), np.diff(np.append(first, len(s)))


NONE = np.zeros(0, dtype=np.uint64)


def is_in(keys: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``common``."""
    if not len(common):
        return np.zeros(len(keys), dtype=bool)
    return common[np.minimum(np.searchsorted(common, keys), len(common) - 1)] == keys


def block_keys(s: np.ndarray, band: int, d: int | None, common: np.ndarray = NONE) -> np.ndarray:
    """Keys of d + 1 blocks of the set ``s`` in a size band, or of all its blocks (d None)."""
    salt = np.array([band], dtype=np.uint64) * _C2
    if band < PLAIN.bit_length() - 1:
        keys = mix64(s ^ _C3) + salt
        count = None
    else:
        number, value, count = _blocks(s, int(LOAD * (1 << band)))
        keys = mix64(value + number * _C3) + salt
    if d is None:
        return keys
    if len(keys) <= d:
        raise ValueError(f"{len(keys)} blocks in use for {len(s)} shingles: no pigeonhole for distance {d}")
    late = is_in(keys, common)
    return keys[np.lexsort((keys, late) if count is None else (keys, -count, late))[:d + 1]]


def set_keys(s: np.ndarray, num: int, den: int, common: np.ndarray = NONE, whole: bool = False) -> np.ndarray:
    """All keys of a set: in its own band, and in the lower bands of smaller partners.
    whole: of all blocks instead of d + 1."""
    n, out = len(s), []
    band = n.bit_length() - 1
    out.append(block_keys(s, band, None if whole else (n + n * den // num) * (den - num) // (den + num), common))
    lower = band - 1
    while lower >= 0 and num * n < den * (1 << (lower + 1)):  # a partner of under 2^(lower+1) may do
        largest = (1 << (lower + 1)) - 1
        out.append(block_keys(s, lower, None if whole else (n + largest) * (den - num) // (den + num), common))
        lower -= 1
    return np.concatenate(out)


def sketch_bits(n: int) -> int:
    """Length of the dense parity sketch of a set of n shingles: 4 to 8 bits a shingle, so
    that few differences cancel and the bound is nearly the difference itself."""
    return min(1 << 18, max(256, 1 << (n.bit_length() + 2)))


def dense_sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles on each bit.  Halving it by XOR of its halves gives the
    sketch of half the length, so sketches of different lengths can be compared."""
    bits = sketch_bits(len(s))
    flips = np.bincount((mix64(s ^ _C2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def identity(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128-bit identity of a set: two independent sums over its members.  bits: how many
    the first part keeps (fewer in tests, so that sets clash)."""
    a = int(np.add.reduce(mix64(s ^ _C1))) ^ (len(s) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a &= (1 << bits) - 1
    b = int(np.add.reduce(mix64(s + _C3)))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def _named(column, width: int, bits: int, clash: frozenset[int], seen: set[int]):
    """(node, set) of the non-empty sets of a column that ``seen`` does not hold yet."""
    for _, s in shingle_sets(column, width):
        if len(s):
            node, check = identity(s, bits)
            if node in clash:
                node = check
            if node not in seen:
                seen.add(node)
                yield node, s


def _portions(items, size, limit: int = 1 << 22):
    """Lists of consecutive items of about ``limit`` bytes, so that what a task hands out
    at a time does not follow the length of the texts in a batch."""
    held, total = [], 0
    for x in items:
        held.append(x)
        total += size(x)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def _describe(width: int, bits: int):
    def described(row, s):
        return (row, len(s), *identity(s, bits), dense_sketch(s)) if len(s) else (row, 0, None, None, None)

    def run(batches):
        for batch in batches:
            rows = (described(row, s) for row, s in shingle_sets(batch.column(1), width))
            for part in _portions(rows, lambda x: len(x[4] or b"") + 64):
                row, n, node, check, sketch = zip(*part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row[0], len(row)), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                     pa.array(check, pa.int64()), pa.array(sketch, pa.binary())], ["doc_id", "n", "node", "check", "sketch"])
    return run


def _counted(width: int, num: int, den: int, bits: int, clash: frozenset[int]):
    """(bucket, sets): keys that SOME or more different sets of a chunk hold."""
    def run(batches):
        seen: set[int] = set()
        held, size = [], 0

        def counts():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= SOME
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(times[often].astype(np.int64))],
                                              ["bucket", "sets"])
        for batch in batches:
            for _, s in _named(batch.column(0), width, bits, clash, seen):
                held.append(set_keys(s, num, den, whole=True))
                size += len(held[-1])
                if size >= 1 << 20:
                    yield counts()
                    held, size = [], 0
        if held:
            yield counts()
    return run


def _keys(width: int, num: int, den: int, bits: int, clash: frozenset[int], common: np.ndarray):
    """(bucket, node, salt) of the sets; salt: 0, of common keys 1 to 4096 by class."""
    def run(batches):
        seen: set[int] = set()  # sets of this task: copies give their keys once
        for batch in batches:
            named = _named(batch.column(0), width, bits, clash, seen)
            keyed = ((node, set_keys(s, num, den, common)) for node, s in named)
            for part in _portions(keyed, lambda x: x[1].nbytes):
                k = np.concatenate([x for _, x in part])
                v = np.repeat(np.array([node for node, _ in part], dtype=np.int64), [len(x) for _, x in part])
                salt = np.where(is_in(k, common), 1 + (v & 4095), 0)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(v), pa.array(salt)], ["bucket", "node", "salt"])
    return run


def _sets(width: int, bits: int, clash: frozenset[int]):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in _portions(_named(batch.column(0), width, bits, clash, seen), lambda x: x[1].nbytes):
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()),
                                                  pa.array([s.tobytes() for _, s in part], pa.binary())], ["node", "members"])
    return run


def _meeting(batches):
    """Of one partition's (bucket, node, salt): the rows of buckets with two nodes or more,
    and all rows of common keys, whose buckets are spread over many partitions."""
    parts = [tuple(np.asarray(b.column(i)) for i in range(3)) for b in batches]
    if not parts:
        return
    bucket, node, salt = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((node, bucket))
    bucket, node, spread = bucket[order], node[order], salt[order] > 0
    new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])))
    bucket, node, spread = bucket[new], node[new], spread[new]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
    size = np.diff(np.append(first, len(bucket)))
    low = np.repeat(node[first], size)
    keep = np.repeat(size > 1, size) | spread
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (bucket, node, low, spread)], ["bucket", "node", "low", "spread"])


def _groups(batches):
    """Whole groups (column 0) of sorted batches, at least a batch at a time."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        g = held.column(0).to_numpy()
        if not len(g) or g[0] == g[-1]:
            continue
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1
        yield held.slice(0, cut)
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _close(t: pa.Table, num: int, den: int):
    """(i, j, apart): places in a table (group, node, root, n, side, sketch) of whole groups of
    the pairs in different components that size and dense sketch allow."""
    group, node, root, n, side = (t.column(i).to_numpy() for i in range(5))
    raw = t.column(5).to_pylist()
    # All sketches are folded to the shortest of the chunk's groups, group by group.
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(first, len(group)))
    wide = np.repeat(np.minimum.reduceat([len(x) for x in raw], first), size)
    end = np.repeat(first + size, size)
    at = np.arange(len(group))
    by_width = {}
    for w in np.unique(wide).tolist():
        rows = np.flatnonzero(wide == w)
        m = np.empty((len(rows), w // 8), dtype=np.uint64)
        for i, r in enumerate(rows.tolist()):
            s = np.frombuffer(raw[r], dtype=np.uint64)
            while len(s) > w // 8:
                s = s[:len(s) // 2] ^ s[len(s) // 2:]
            m[i] = s
        by_width[w] = (rows, m)
    place = np.empty(len(group), dtype=np.int64)
    for rows, _ in by_width.values():
        place[rows] = np.arange(len(rows))
    out = [(np.zeros(0, np.int64),) * 3]
    for step in range(1, int(size.max())):
        i = at[at + step < end]
        j = i + step
        ok = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] < 0))
        i, j = i[ok], j[ok]
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = small * den >= large * num
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        for w, (_, m) in by_width.items():
            here = wide[i] == w
            x, y = i[here], j[here]
            for lo in range(0, len(x), 1 << 14):
                p, q = x[lo:lo + (1 << 14)], y[lo:lo + (1 << 14)]
                apart = np.bitwise_count(m[place[p]] ^ m[place[q]]).sum(axis=1, dtype=np.int64)
                near = apart * (den + num) <= (n[p] + n[q]) * (den - num)
                out.append((p[near], q[near], apart[near]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _close_pairs(num: int, den: int):
    """Pairs of a group in different components, by size and dense sketch."""
    def run(batches):
        for t in _groups(batches):
            node = t.column(1).to_numpy()
            i, j, _ = _close(t, num, den)
            if len(i):
                pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
    return run


def _spanning(i: np.ndarray, j: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest (Boruvka; edges come in the order of
    their weights): fewer than there are components."""
    component, left, chosen = component.copy(), np.arange(len(i)), []
    while True:
        left = left[component[i[left]] != component[j[left]]]
        if not len(left):
            return np.concatenate(chosen) if chosen else left
        best = np.full(int(component.max()) + 1, len(i), dtype=np.int64)
        np.minimum.at(best, component[i[left]], left)
        np.minimum.at(best, component[j[left]], left)
        edges = np.unique(best[best < len(i)])
        chosen.append(edges)
        low = np.arange(len(best))
        for a, b in zip(component[i[edges]].tolist(), component[j[edges]].tolist()):
            while low[a] != a:
                a = low[a]
            while low[b] != b:
                b = low[b]
            low[max(a, b)] = min(a, b)
        while (low[low] != low).any():
            low = low[low]
        component = low[component]


def _nearest_pairs(num: int, den: int):
    """(group, a, b): of the close pairs of a group, a spanning forest over its components, the
    nearest first: fewer rows than the group has classes, however many pairs are close."""
    def run(batches):
        for t in _groups(batches):
            group, node, root = (t.column(c).to_numpy() for c in range(3))
            i, j, apart = _close(t, num, den)
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            order = np.lexsort((b, a, apart))
            component = np.unique(np.stack([group, root]), axis=1, return_inverse=True)[1].reshape(-1)
            edges = order[_spanning(i[order], j[order], component)]
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(group[i[edges]]), pa.array(a[edges]), pa.array(b[edges])], ["g", "a", "b"])
    return run


def _verify(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _near(num: int, den: int):
    """Pairs (a, b, n_a, n_b, sketch_a, sketch_b) whose sketches allow a link."""
    def run(batches):
        for batch in batches:
            n1, n2 = (np.asarray(batch.column(i)) for i in (2, 3))
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                while len(p) > len(q):
                    p = p[:len(p) // 2] ^ p[len(p) // 2:]
                while len(q) > len(p):
                    q = q[:len(q) // 2] ^ q[len(q) // 2:]
                keep.append(int(np.bitwise_count(p ^ q).sum()) * (den + num) <= int(n1[i] + n2[i]) * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _with_both(pairs: DataFrame, of: DataFrame, cols: list[str]) -> DataFrame:
    one = of.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    two = of.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return pairs.join(one, "a").join(two, "b").select("a", "b", *[x for c in cols for x in (f"{c}_a", f"{c}_b")])


def _common_keys(src: DataFrame, width: int, num: int, den: int, bits: int, clash: frozenset[int]) -> np.ndarray:
    """Sorted keys that more than PART sets hold, and more than the COMMONth part of all
    that were counted: at most COMMON keys, whatever the size of the corpus."""
    counted = written(src.select("text").mapInArrow(_counted(width, num, den, bits, clash), "bucket long, sets long")
                      .groupBy("bucket").agg(F.sum("sets").alias("sets")), "jaccard-counted")
    total = counted.agg(F.sum("sets")).first()[0] or 0
    often = counted.where(F.col("sets") > max(PART, total // COMMON)).select("bucket").toArrow()
    return np.sort(often.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _meetings(docs: DataFrame, width: int, num: int, den: int, bits: int):
    """(rows, classes, (bucket, node, low) of buckets with two classes or more, sketches of
    these, a function that leaves the linked ones of a table of pairs)."""
    src = text_only(docs)
    described = written(src.mapInArrow(_describe(width, bits), "doc_id long, n long, node long, check long, sketch binary"), "jaccard-rows")

    def classes(rows: DataFrame) -> DataFrame:
        return written(rows.where("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("low"), F.min("check").alias("c1"), F.max("check").alias("c2")), "jaccard-classes")

    rows, sets, clash = described, classes(described), frozenset()
    clashing = sets.where("c1 <> c2").select("node")
    if not clashing.isEmpty():
        # About n * n / 2^65 of n sets: some dozens at 5e10 documents.
        clash = frozenset(clashing.toArrow().column(0).to_pylist())
        other = F.broadcast(clashing.select(F.col("node").alias("taken")))
        rows = described.join(other, F.col("node") == F.col("taken"), "left").select(
            "doc_id", "n", F.when(F.col("taken").isNull(), F.col("node")).otherwise(F.col("check")).alias("node"), "check", "sketch")
        sets = classes(rows)
        if not sets.where("c1 <> c2").isEmpty():
            raise ValueError("two different sets share the second half of their identity too")
    common = _common_keys(src, width, num, den, bits, clash)
    met = written(src.select("text").mapInArrow(_keys(width, num, den, bits, clash, common), "bucket long, node long, salt long")
                  .repartition("bucket", "salt").mapInArrow(_meeting, "bucket long, node long, low long, spread boolean"),
                  "jaccard-buckets")
    lows = written(met.where("spread").groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
                   .where("low < high").select("bucket", "low"), "jaccard-common")
    meet = met.where("not spread").select("bucket", "node", "low").unionByName(
        met.where("spread").select("bucket", "node").join(small_side(lows, 16), "bucket").select("bucket", "node", "low"))
    nodes = written(meet.select("node").distinct(), "jaccard-nodes")
    texts = src.select("text").mapInArrow(_sets(width, bits, clash), "node long, members binary")
    members = written(texts.join(small_side(nodes, 16), "node", "left_semi").dropDuplicates(["node"]), "jaccard-sets")
    sketches = written(rows.select("node", "n", "sketch").join(small_side(nodes, 16), "node", "left_semi")
                       .dropDuplicates(["node"]), "jaccard-sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        return written(_with_both(pairs, members, ["members"]).mapInArrow(_verify(num, den), "a long, b long"), "jaccard-links")
    return rows, sets, meet, sketches, verified


def _contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after links between components: contracted to their roots and connected."""
    if links.isEmpty():
        return roots
    lifted = (links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
              .join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    joined = components(lifted)
    top = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    lone = joined.join(roots, "node", "left_anti").select("node", "root")
    return written(roots.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
                   .unionByName(lone), "jaccard-final")


def jaccard_classes(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_shingles, class_id, component_id.

    Two documents link when ``den * |A and B| >= num * |A or B|`` of their distinct
    ``width``-word shingles; component_id is the smallest doc_id that a document reaches by
    links, class_id the smallest doc_id with exactly its set.

    Null and empty texts (and texts without a word) have an empty set, link with nothing and
    are their own component and class.  bits: length of the sets' short names (see ``identity``).  A text of under ``width`` words has one shingle, the
    whole sequence.  Rows with a null doc_id take part; a component made of such rows only
    has a null id.  Repeated rows give repeated rows.  Extra columns are ignored.
    """
    rows, sets, meet, sketches, verified = _meetings(docs, width, num, den, bits)
    star = meet.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    star = _with_both(star, sketches, ["n", "sketch"]).mapInArrow(_near(num, den), "a long, b long")
    links = verified(star)
    first = written(components(links), "jaccard-first")
    rooted = meet.select("bucket", "node").join(first, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "jaccard-rooted")
    # Per bucket the largest component: its classes never need to meet each other.
    several = rooted.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    mixed = several.groupBy("bucket").agg(F.sum("size").alias("size"), F.max(F.struct("size", "root")).alias("top"),
                                          F.count("*").alias("roots"))
    mixed = written(mixed.where("roots > 1").select(
        "bucket", F.col("top.root").alias("top"), (F.col("size") <= PART).alias("whole"),
        F.ceil((F.col("size") - F.col("top.size")) / PART).cast("int").alias("q"),
        F.ceil(F.col("top.size") / PART).cast("int").alias("q_top")), "jaccard-mixed")
    # Parts 0 to q - 1 hold the other components, the next q_top the largest; a small bucket is one part.
    parts = (rooted.join(mixed, "bucket")
             .withColumn("c", F.expr("""case when whole then 0 when root = top then q + pmod(xxhash64(node), q_top)
                                        else pmod(xxhash64(node), q) end"""))
             .withColumn("o", F.explode(F.expr("""sequence(0L, cast(case when whole then 0 when root = top then q - 1
                                                  else q + q_top - 1 end as bigint))""")))
             .select(F.expr("xxhash64(bucket, least(c, o), greatest(c, o))").alias("g"), "node", "root",
                     F.expr("if(c = o, -1, if(c < o, 0, 1))").alias("side")))
    parts = parts.withColumn("side", F.col("side").cast("int"))

    def compared(rows_of: DataFrame, fn, schema: str) -> DataFrame:
        return (rows_of.join(sketches, "node").select("g", "node", "root", "n", "side", "sketch")
                .repartition("g").sortWithinPartitions("g").mapInArrow(fn, schema))
    near = written(compared(parts, _nearest_pairs(num, den), "g long, a long, b long"), "jaccard-near")
    links = verified(near.select("a", "b").distinct())
    final = _contracted(first, links)
    # Groups where a pair that looked close was no link: all that is still apart is verified.
    open_groups = written(near.join(links, ["a", "b"], "left_anti").select("g").distinct(), "jaccard-open")
    left = (parts.join(small_side(open_groups, 16), "g", "left_semi").join(final.select("node", F.col("root").alias("now")), "node", "left")
            .select("g", "node", F.coalesce("now", "root").alias("root"), "side"))
    across = compared(left, _close_pairs(num, den), "a long, b long").distinct()
    final = _contracted(final, verified(across))
    grouped = sets.join(final, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = grouped.join(lowest, "root").select("node", F.col("low").alias("class_id"), "component_id")
    own = F.col("node").isNull()
    # A class with a third of all rows meets one row of ``named``: salted over the shuffle.
    salts = 16
    salted = named.withColumn("salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    out = rows.select("doc_id", "n", "node").withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id), {salts}) as int)"))
    return out.join(salted, ["node", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_links(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(links, members): every linked pair of different sets, and the documents of the sets.

    links has one row (a, b), a < b, for each pair of classes that link; members one row per
    input row: doc_id, n_shingles, component_id (as in ``jaccard_classes``), node (the name of
    its set, null if it is empty) and n_links, the number of other rows that it links with: those
    of its own class and of the linked ones.  Rows are counted as they come, also repeated ones
    and those with a null doc_id.

    All pairs of a bucket are compared, part by part, also inside a component: the work and
    the rows of links grow with the number of pairs that do link."""
    rows, sets, meet, sketches, verified = _meetings(docs, width, num, den, bits)
    meet = written(meet.select("bucket", "node"), "jaccard-meet")
    sizes = written(meet.groupBy("bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("q")), "jaccard-parts")
    parts = (meet.join(sizes, "bucket").withColumn("c", F.expr("cast(pmod(xxhash64(node), q) as int)"))
             .withColumn("o", F.explode(F.expr("sequence(0, q - 1)")))
             .select(F.expr("xxhash64(bucket, least(c, o), greatest(c, o))").alias("g"), "node",
                     F.expr("if(c = o, -1, if(c < o, 0, 1))").cast("int").alias("side")))
    # Each class is its own root: no pair is passed over.
    parts = (parts.join(sketches, "node").select("g", "node", F.col("node").alias("root"), "n", "side", "sketch")
             .repartition("g").sortWithinPartitions("g"))
    links = verified(parts.mapInArrow(_close_pairs(num, den), "a long, b long").distinct())
    held = written(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("size")), "jaccard-sizes")
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(held.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    grouped = sets.join(components(links), "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    named = held.join(others, F.col("node") == F.col("a"), "left").join(grouped.join(lowest, "root").select("node", "component_id"), "node").select(
        "node", "component_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    salts = 16
    salted = named.withColumn("salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    out = rows.select("doc_id", "n", "node").withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id), {salts}) as int)"))
    return links, out.join(salted, ["node", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "node", F.coalesce("n_links", F.lit(0)).alias("n_links"))
