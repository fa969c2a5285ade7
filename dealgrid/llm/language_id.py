"""Language identification by a linear-chain conditional random field (operator 6).

Every word of a text gets a distribution over languages by forward-backward: its features
(affixes, character n-grams inside word marks, the word itself as a lexicon entry) weigh for
each language, and learned transitions say how readily neighbours switch.  So a text that
mixes languages is labelled word by word, and the text's language is the one with the
largest expected number of words.

The field is trained by stochastic gradient steps on its log-likelihood, on a bounded
sample of labelled rows (``max_rows``).  Sequences that switch language are made by joining
parts of different sample texts, so that the transitions are learned too.  At prediction
the chain restarts every ``STEP`` words: all pieces of a chunk of texts are stepped through
together and memory follows the chunk, not the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dealgrid.llm.common import in_tasks, text_only
from dealgrid.llm.text import _LOWER, _NOT_TERM, mix64, spans, text_buffer, _hashes

BITS = 18
MAX_ROWS = 3000
STEP = 64
AFFIX = 4


def _word_spans(raw: np.ndarray, starts_at: np.ndarray):
    """(start, length, hash) of the words of a lower-cased buffer."""
    starts, hashes = _hashes(raw, starts_at, "terms")
    if not len(starts):
        return starts, starts, hashes
    stop = np.empty(len(raw), dtype=bool)
    gap = _NOT_TERM[raw]
    stop[-1] = True
    stop[:-1] = gap[1:]
    inner = starts_at[(starts_at > 0) & (starts_at < len(raw))]
    stop[inner - 1] = True
    return starts, np.flatnonzero(stop & ~gap) + 1 - starts, hashes


def features(raw: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray):
    """(fixed, grams, offsets): feature numbers of words; fixed: affixes and lexicon entry, one
    column each; grams: character trigrams of ``^word$``, from offsets[i] on for word i."""
    n = len(start)
    shift = np.uint64(64 - BITS)
    fixed = np.empty((n, 2 * AFFIX + 1), dtype=np.int32)
    fixed[:, 0] = (mix64(hashes) >> shift).astype(np.int32)
    front = np.zeros(n, dtype=np.uint64)
    back = np.zeros(n, dtype=np.uint64)
    for k in range(AFFIX):
        has = length > k
        front = np.where(has, front << np.uint64(8) | raw[np.where(has, start + k, 0)], front)
        back = np.where(has, back << np.uint64(8) | raw[np.where(has, start + length - 1 - k, 0)], back)
        fixed[:, 1 + 2 * k] = (mix64(front + np.uint64((2 * k + 1) << 40)) >> shift).astype(np.int32)
        fixed[:, 2 + 2 * k] = (mix64(back + np.uint64((2 * k + 2) << 40)) >> shift).astype(np.int32)
    wide = length + 2
    offsets = np.cumsum(wide) - wide
    flat = np.full(int(wide.sum()), ord("^"), dtype=np.uint64)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    flat[np.repeat(offsets + 1, length) + inner] = raw[np.repeat(start, length) + inner]
    flat[offsets + wide - 1] = ord("$")
    tri = flat[:-2] | flat[1:-1] << np.uint64(8) | flat[2:] << np.uint64(16) if len(flat) > 2 else flat[:0]
    at = np.repeat(offsets, length) + inner  # trigrams that stay in the word: one for each byte
    grams = (mix64(tri[at] + np.uint64(99 << 40)) >> shift).astype(np.int32)
    return fixed, grams, np.cumsum(length) - length


class WordField:
    """The field's weights: features x labels, and transitions between labels."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << BITS, len(labels)), dtype=np.float32)
        self.moves = np.zeros((len(labels), len(labels)))

    def emissions(self, fixed, grams, offsets) -> np.ndarray:
        out = self.weights[fixed].sum(axis=1)
        if len(grams):
            out += np.add.reduceat(self.weights[grams], offsets, axis=0)
        return out

    def marginals(self, e: np.ndarray, real: np.ndarray):
        """Label probabilities of sequences (steps x sequences x labels) by forward-backward;
        ``real`` marks steps that exist.  Also the expected label pairs, summed."""
        steps, count, k = e.shape
        psi = np.exp(e - e.max(axis=2, keepdims=True))
        move = np.exp(self.moves)
        ahead = np.empty_like(psi)
        ahead[0] = psi[0] / psi[0].sum(axis=1, keepdims=True)
        for t in range(1, steps):
            x = (ahead[t - 1] @ move) * psi[t]
            ahead[t] = x / x.sum(axis=1, keepdims=True)
        back = np.ones((count, k))
        out = np.empty_like(psi)
        pairs = np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            x = ahead[t] * back
            out[t] = x / x.sum(axis=1, keepdims=True)
            if t:
                y = psi[t] * back
                z = y @ move.T
                both = real[t]
                norm = (ahead[t - 1] * z).sum(axis=1)
                pairs += ((ahead[t - 1] / norm[:, None])[both].T @ y[both]) * move
                back = np.where(both[:, None], z / z.sum(axis=1, keepdims=True), 1.0)
        return out, pairs

    def fit(self, texts: list[bytes], langs: list[int], epochs: int = 3, batch: int = 128, rate: float = 0.2) -> None:
        """Adagrad on sequences of STEP words, every other one with a switch in it."""
        rng = np.random.default_rng(3)
        k = len(self.labels)
        joined = _LOWER[np.frombuffer(b" ".join(texts), dtype=np.uint8)] if texts else np.zeros(0, np.uint8)
        cuts = np.cumsum([len(t) + 1 for t in texts]) - [len(t) + 1 for t in texts] if texts else np.zeros(0, np.int64)
        start, length, hashes = _word_spans(joined, cuts)
        if not len(start):
            return
        _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        fixed, grams, offsets = features(joined, start[first], length[first], hashes[first])
        size = length[first]
        owner = np.searchsorted(cuts, start, side="right") - 1
        gold = np.asarray(langs)[owner]
        pieces = []
        for t in range(len(texts)):
            a, b = np.searchsorted(owner, [t, t + 1])
            pieces += [np.arange(i, min(i + STEP, b)) for i in range(a, b, STEP)]
        g_w, g_m = np.full(self.weights.shape, 1e-4, dtype=np.float32), np.full(self.moves.shape, 1e-4)
        for _ in range(epochs):
            order = rng.permutation(len(pieces))
            for lo in range(0, len(order), batch):
                seqs = []
                for i in order[lo:lo + batch].tolist():
                    p = pieces[i]
                    if i % 2:
                        q, cut = pieces[int(rng.integers(len(pieces)))], int(rng.integers(1, STEP))
                        p = np.concatenate([p[:cut], q[cut:]])
                    seqs.append(p)
                idx = np.full((STEP, len(seqs)), -1)
                for j, p in enumerate(seqs):
                    idx[:len(p), j] = p
                real = idx >= 0
                words = np.unique(word[idx[real]])
                grams_at, counts = _gather(offsets, size, words)
                ends = np.cumsum(counts) - counts
                emit = self.emissions(fixed[words], grams[grams_at], ends)
                place = np.zeros(idx.shape, dtype=np.int64)
                place[real] = np.searchsorted(words, word[idx[real]])
                e = np.where(real[:, :, None], emit[place], 0.0)
                prob, pairs = self.marginals(e, real)
                gold_at = gold[idx]
                prob[np.arange(STEP)[:, None], np.arange(len(seqs))[None, :], gold_at] -= 1.0
                prob[~real] = 0
                miss = np.stack([np.bincount(place[real], prob[..., x][real], minlength=len(words)) for x in range(k)], axis=1)
                miss /= len(seqs)
                grad = np.zeros(self.weights.shape, dtype=np.float32)
                slots = np.concatenate([fixed[words].ravel(), grams[grams_at]])
                source = np.concatenate([np.repeat(np.arange(len(words)), fixed.shape[1]), np.repeat(np.arange(len(words)), counts)])
                used = np.unique(slots)
                local = np.searchsorted(used, slots)
                for x in range(k):
                    grad[used, x] = np.bincount(local, miss[source, x], minlength=len(used))
                g_w[used] += grad[used] ** 2
                self.weights[used] -= rate * grad[used] / np.sqrt(g_w[used])
                seen = np.zeros((k, k))
                both = real[1:] & real[:-1]
                np.add.at(seen, (gold_at[:-1][both], gold_at[1:][both]), 1)
                d = (pairs - seen) / len(seqs)
                g_m += d * d
                self.moves -= 0.5 * rate * d / np.sqrt(g_m)

    def predict(self, column):
        """Yields (lo, hi, expected words of each label) for rows lo..hi-1."""
        raw, off = text_buffer(column)
        k = len(self.labels)
        for lo, hi in spans(off):
            part, cut = _LOWER[raw[off[lo]:off[hi]]], off[lo:hi + 1] - off[lo]
            start, length, hashes = _word_spans(part, cut[:-1])
            total = np.zeros((hi - lo, k))
            if len(start):
                _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
                emit = self.emissions(*features(part, start[first], length[first], hashes[first]))
                row = np.searchsorted(cut, start, side="right") - 1
                head = np.searchsorted(row, row)  # first word of the word's text
                step = (np.arange(len(row)) - head) % STEP
                piece = np.cumsum(step == 0) - 1
                for a in range(0, int(piece[-1]) + 1, 4096):  # pieces stepped through together
                    x, y = np.searchsorted(piece, [a, a + 4096])
                    at, s = piece[x:y] - a, step[x:y]
                    real = np.zeros((STEP, int(at[-1]) + 1), dtype=bool)
                    real[s, at] = True
                    e = np.zeros((*real.shape, k))
                    e[s, at] = emit[word[x:y]]
                    prob, _ = self.marginals(e, real)
                    p = prob[s, at]
                    for c in range(k):
                        total[:, c] += np.bincount(row[x:y], p[:, c], minlength=hi - lo)
            yield lo, hi, total


def _gather(offsets: np.ndarray, size: np.ndarray, words: np.ndarray):
    counts = size[words]
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(offsets[words], counts) + inner, counts


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> WordField | None:
    """The field, learned from at most ``max_rows`` whole texts with a lang, taken by a hash
    of the id; rows whose crc32(doc_id as text) mod 3 is 1 are held out.  None without any."""
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
              .where("doc_id is not null and lang is not null and crc32(cast(doc_id as string)) % 3 <> 1")
              .groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in text_only(docs).where("text is not null").join(
        F.broadcast(sample), "doc_id").toLocalIterator())
    labels = sorted({x for _, x, _ in rows})
    if not labels:
        return None
    field = WordField(labels)
    field.fit([t.encode() for _, _, t in rows], [labels.index(x) for _, x, _ in rows])
    return field


def identify(docs: DataFrame, field: WordField | None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    score is the share of the text's expected words that lang_pred has.  lang_pred is ``und``
    with score 0 if the text is null, empty or has no letter, or if nothing was learned.  Ties
    go to the first label by code point.  Null doc_ids (never held out) and repeated rows are
    kept as they come; extra columns are ignored."""
    shared = in_tasks(docs.sparkSession, field)

    def run(batches):
        field = shared()
        for batch in batches:
            column, lang, score = batch.column(1), [], []
            for lo, hi, total in field.predict(column) if field is not None else ():
                sums = total.sum(axis=1)
                best = total.argmax(axis=1)
                for i, (s, b) in enumerate(zip(sums.tolist(), best.tolist())):
                    known = s > 0 and any(c.isalpha() for c in column[lo + i].as_py())
                    lang.append(field.labels[b] if known else "und")
                    score.append(float(min(1.0, total[i, b] / s)) if known else 0.0)
            if field is None:
                lang, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])
    named = text_only(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return named.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out"),
                        "lang_pred", "score")
