"""Toxicity scores by a factorization machine over hashed terms (operator 3).

A document's features are its distinct terms (runs of letters and digits, A-Z folded),
hashed.  The machine adds to the linear weights a learned interaction of every two terms,
the product of their factors, so that a term may weigh more beside another one.  It is
fitted on a bounded sample of labelled rows (``max_rows``, taken by a hash of the id).  Every
hashed term of the sample has a weight and factors in the fit; one that pulls no more to one
side than chance would (its gradients' sum over the rows against the root of their squares' sum) stays at
zero, so the scores of long texts do not drown in the noise of thousands of neutral terms, and
terms that tell the labels apart only in pairs are learned too.  The machine keeps the terms
that moved, at most 2^20.  Every text is scored whole, in one pass, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealgrid.llm.common import in_tasks, text_only
from dealgrid.llm.text import word_hashes

HASH_BITS = 20
MAX_ROWS = 20_000   # labelled rows that the machine is fitted on, at most
FACTORS = 4
PIECES = 64         # passes over the sample's terms on the driver go piece by piece


def term_slots(column, slots: np.ndarray | None = None):
    """Yields (row, slot) arrays of the distinct hashed terms of each row, in row order;
    with ``slots`` only terms that have one."""
    for lo, hi, hashes, counts in word_hashes(column, "terms"):
        slot = (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        row = np.repeat(np.arange(lo, hi), counts)
        if slots is not None:
            slot = slots[slot]
            row, slot = row[slot >= 0], slot[slot >= 0]
        both = np.unique((row << HASH_BITS) | slot)
        yield both >> HASH_BITS, both & ((1 << HASH_BITS) - 1)


class FactorizationMachine:
    """score = bias + sum of weights + interactions of all pairs of a row's features."""

    def __init__(self, slots: np.ndarray, terms: int, bias: float):
        rng = np.random.default_rng(11)
        self.slots, self.bias = slots, bias
        self.weights = np.zeros(terms)
        self.factors = rng.normal(0, 0.01, (terms, FACTORS))

    def logits(self, row: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(row, self.weights[slot], minlength=n)
        v = self.factors[slot]
        total = np.stack([np.bincount(row, v[:, f], minlength=n) for f in range(FACTORS)], axis=1)
        square = np.bincount(row, (v * v).sum(axis=1), minlength=n)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - square)

    def scores(self, column) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for row, slot in term_slots(column, self.slots):
            if len(row):
                lo, hi = int(row[0]), int(row[-1]) + 1
                out[lo:hi] = self.logits(row - lo, slot, hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def fit(self, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 8, parts: int = 32,
            rates: tuple[float, float] = (1.0, 0.5), chance: tuple[float, float] = (3.0, 3.0)) -> None:
        """Follow-the-regularised-leader on the logistic loss, ``parts`` steps an epoch; the rarer
        label 1 weighs up to 4 times as much.  ``flat`` holds the terms of all rows, ``sizes`` of
        each.  A weight (factor) leaves its start once its gradients sum to more than ``chance``
        deviations.  Terms that never leave it end at zero."""
        rng, terms = np.random.default_rng(5), len(self.weights)
        heavy = min(4.0, max(1.0, (len(labels) - labels.sum()) / max(labels.sum(), 1)))
        start = np.column_stack([self.weights, self.factors])
        moved, pull, squares, spread = (np.zeros((terms, FACTORS + 1)) for _ in range(4))
        rate, limit = (np.array([x[0]] + [x[1]] * FACTORS) for x in (rates, chance))
        begin, bias_squares = np.cumsum(sizes) - sizes, 1.0
        for epoch in range(epochs):
            for take in np.array_split(rng.permutation(len(labels)), max(1, min(parts, len(labels) // 16))):
                n = sizes[take]
                row = np.repeat(np.arange(len(take)), n)
                slot = flat[np.repeat(begin[take] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                miss = 1 / (1 + np.exp(-np.clip(self.logits(row, slot, len(take)), -30, 30))) - labels[take]
                miss = miss * np.where(labels[take] > 0, heavy, 1.0)
                bias_squares += miss.sum() ** 2
                self.bias -= rate[0] * miss.sum() / np.sqrt(bias_squares)
                if not len(slot):
                    continue
                v, share = self.factors[slot], miss[row]
                others = [np.bincount(row, v[:, f], minlength=len(take))[row] - v[:, f] for f in range(FACTORS)]
                met = np.flatnonzero(np.bincount(slot, minlength=terms))
                grad = np.stack([np.bincount(slot, share * x, minlength=terms)[met] for x in (1.0, *others)], axis=1)
                spread[met] += np.stack([np.bincount(slot, np.square(share * x), minlength=terms)[met] for x in (1.0, *others)], axis=1)
                before, now = np.sqrt(squares[met]), np.sqrt(squares[met] + grad * grad)
                pull[met] += grad - (now - before) / rate * moved[met]
                squares[met] += grad * grad
                # The same rows pull again in each epoch, so chance grows with their number.
                slack = np.abs(pull[met]) - limit * (1 + np.sqrt(spread[met])) * np.sqrt(epoch + 1)
                moved[met] = np.where(slack > 0, -np.sign(pull[met]) * slack * rate / (1 + now), 0.0)
                self.weights[met] = start[met, 0] + moved[met, 0]
                self.factors[met] = start[met, 1:] + moved[met, 1:]
        self.factors[~moved.any(axis=1) & (self.weights == 0)] = 0.0

    def without_zeros(self) -> "FactorizationMachine":
        """The same machine holding only the terms that weigh something."""
        used = np.flatnonzero((self.weights != 0) | self.factors.any(axis=1))
        place = np.full(len(self.weights) + 1, -1, dtype=np.int32)
        place[used] = np.arange(len(used))
        out = FactorizationMachine(place[self.slots], len(used), self.bias)  # slot -1 takes the last place, -1
        out.weights, out.factors = self.weights[used], self.factors[used]
        return out


def _features(batches):
    for batch in batches:
        rows = [np.zeros(0, dtype=np.int32)] * batch.num_rows
        for row, slot in term_slots(batch.column(1)):
            if len(row):
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                for r, s in zip(row[first].tolist(), np.split(slot.astype(np.int32), first[1:])):
                    rows[r] = s
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))],
                                         ["toxic", "slots"])


def _in_order(lists: pa.ChunkedArray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all rows as one int32 array and the number of each row.  The order of the
    collected rows depends on the tasks: they (and ``toxic``, in place) are sorted by content."""
    if not len(toxic):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    rows = []
    for chunk in lists.chunks:  # views of the collected buffers
        rows += np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])[:len(chunk)]
    sizes, order = np.array([len(r) for r in rows], dtype=np.int64), []
    by_size = np.argsort(sizes, kind="stable")
    for same in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1):
        order += sorted(same.tolist(), key=lambda i: (rows[i].tobytes(), toxic[i]))
    toxic[:] = toxic[order]
    return np.concatenate([rows[i] for i in order]), sizes[order]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """The machine fitted on at most ``max_rows`` labelled documents, whole texts.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out.  Null ids and labels are passed
    over; a document labelled twice counts as toxic if any label says so.  Without a labelled
    row every score is 0.25.
    """
    learn = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    sample = (text_only(docs).join(F.broadcast(learn), "doc_id").select("toxic", "text")
              .mapInArrow(_features, "toxic int, slots array<int>").toArrow())
    toxic = sample.column("toxic").to_numpy().astype(float)
    flat, sizes = _in_order(sample.column("slots"), toxic)
    del sample
    n, pos = len(toxic), float(toxic.sum())
    base = (pos + 0.5) / (n + 2)
    met = np.zeros(1 << HASH_BITS, dtype=bool)
    for part in np.array_split(flat, PIECES):
        met[part] = True
    seen = np.flatnonzero(met)
    slots = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    slots[seen] = np.arange(len(seen))
    machine = FactorizationMachine(slots, len(seen), float(np.log(base / (1 - base))))
    if n and 0 < pos < n:
        for part in np.array_split(flat, PIECES):  # views: the terms become places among the seen ones
            part[:] = slots[part]
        machine.fit(flat, sizes, toxic)
        machine = machine.without_zeros()
        # The terms that moved are fitted on without the hold that kept the others at zero.
        place, ends = machine.slots[seen], np.cumsum(sizes)
        left = np.zeros(n, dtype=np.int64)
        kept = []
        for rows in np.array_split(np.arange(n), min(n, PIECES)):
            lo, hi = ends[rows[0]] - sizes[rows[0]], ends[rows[-1]]
            slot = place[flat[lo:hi]]
            left[rows] = np.bincount(np.repeat(np.arange(len(rows)), sizes[rows])[slot >= 0], minlength=len(rows))
            kept.append(slot[slot >= 0])
        machine.fit(np.concatenate(kept), left, toxic, rates=(0.3, 0.15), chance=(0.0, 0.0))
        return machine
    machine.factors[:] = 0.0
    return machine.without_zeros()


def score(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Null and empty texts get the score of a text without any weighed term.  Null doc_ids (never
    held out) and repeated rows are kept as they come; extra columns are ignored."""
    shared = in_tasks(docs.sparkSession, machine)

    def run(batches):
        machine = shared()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(batch.column(1)))], ["doc_id", "score"])
    scored = text_only(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """``docs`` (all columns, text among them) without the rows predicted toxic."""
    shared, text_at = in_tasks(docs.sparkSession, machine), docs.columns.index("text")

    def run(batches):
        machine = shared()
        for batch in batches:
            yield batch.filter(pa.array(machine.scores(batch.column(text_at)) < 0.5))
    return docs.mapInArrow(run, docs.schema)
