"""Byte-level BPE encoding and decoding (operator 13).

A text is split into pieces by the vocabulary's pattern; a piece that is itself a token
becomes that token, any other is merged pair by pair in the order of the ranks.

Encoding runs in one stage, without a shuffle.  Documents are taken in *blocks* of about
``BLOCK_PIECES`` pieces, and only the distinct words of a block are merged:

1. the texts are split, and the words of the block (distinct pieces that are no tokens)
   become arrays of bytes, written as strings with one character for each byte's token; the
   rank map says which tokens are in a word at all, in the order of their ranks;
2. a higher-order function folds those ranked merges over the word: ``replace`` of the pair
   by the merged token's character, left to right.  Pairs and merged tokens come from a
   literal array over the ranks;
3. the words' tokens go back to the places of their pieces.

One merge a token is enough: at the time a token is formed, no merge has crossed its two
ends, so its bytes have been merged as if they stood alone, and the last pair is always the
same.  By the same reason no token turns up after its rank has passed, if every token is
made of tokens of smaller rank; ``Vocabulary`` checks both for the ranks given.

Decoding concatenates the tokens' binary pieces, a buffer at a time.
"""

from __future__ import annotations

import base64
import sys
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from dealgrid.llm.common import text_only

# The functions of this module travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_PIECES = 1 << 20  # pieces of a block: about 5 MB of text, or one longer text
SEARCH_WORDS = 1 << 17  # words that are looked up at a time
PLACE = 0x10000         # token id -> character: all of them take four bytes of UTF-8


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary: all 256 bytes and tokens made of smaller ones."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        if len(self.tokens) > 0x100000 or len(set(ranks.values())) != len(ranks):
            raise ValueError("ranks must be distinct and below 2^20")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs: list[tuple[int, int] | None] = [None] * len(self.tokens)
        for token, rank in ranks.items():
            if len(token) > 1:
                self.pairs[rank] = self._last_pair(token, rank, ranks)

    @staticmethod
    def _last_pair(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``; None if merging never gives it."""
        parts = [token[i:i + 1] for i in range(len(token))]
        late = False
        while len(parts) > 2:
            at = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in at if r is not None), default=None)
            if best is None:
                return None
            late = late or best > rank
            i = at.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if late:
            raise ValueError(f"rank {rank} is smaller than that of a token it is made of")
        return ranks[parts[0]], ranks[parts[1]]

    def literals(self) -> tuple[Column, Column]:
        """Literal arrays over the ranks: the pair's two characters ("" where there is none)
        and the token's character."""
        char = [chr(PLACE + i) for i in range(len(self.tokens))]
        pair = ["" if p is None else char[p[0]] + char[p[1]] for p in self.pairs]
        # Split when the plan is made: one string crosses to the JVM instead of every entry.
        return tuple(F.split(F.lit(",".join(x)), ",") for x in (pair, char))


def load_ranks(path: str) -> Vocabulary:
    """A rank file: a base64 token and its rank on each line.  ``path`` is on the driver."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


class _Substrings:
    """All tokens of two bytes or more that are in words, by their length."""

    def __init__(self, tokens: list[bytes | None], mergeable: list[bool]):
        self.by_length = {}
        for n in sorted({len(t) for t in tokens if t is not None} - {1}):
            of = [(t, i) for i, t in enumerate(tokens) if t is not None and len(t) == n and mergeable[i]]
            if of:
                raw = np.frombuffer(b"".join(t for t, _ in of), dtype=np.uint8).reshape(-1, n)
                keys = raw[:, 0].astype(np.uint64)
                for m in range(2, n + 1):
                    keys = self._longer(keys, raw[:, m - 1], m)
                if len(np.unique(keys)) < len(keys):
                    raise ValueError(f"two tokens of {n} bytes share a hash")
                order = np.argsort(keys, kind="stable")
                self.by_length[n] = (keys[order], np.array([i for _, i in of], dtype=np.int32)[order], raw[order])

    @staticmethod
    def _longer(key: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """Numbers of n bytes from those of n - 1 and the last byte: exact up to 8, a hash beyond."""
        return (key << np.uint64(8) if n <= 8 else key * np.uint64(0x9E3779B97F4A7C15)) + last

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, rank) of the tokens in the words of a buffer: each once, by word and rank."""
        word = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
        at = np.arange(len(raw))
        left = np.repeat(offsets[1:], np.diff(offsets)) - at  # bytes up to the word's end
        key, done, found = raw.astype(np.uint64), 1, []
        for n, (keys, ranks, tokens) in self.by_length.items():
            for m in range(done + 1, n + 1):
                go = left[at] >= m
                at, key = at[go], key[go]
                key = self._longer(key, raw[at + m - 1], m)
            done = n
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            here, place = at[hit], place[hit]
            if n > 8:
                same = (raw[here[:, None] + np.arange(n)] == tokens[place]).all(axis=1)
                here, place = here[same], place[same]
            found.append(word[here] << 20 | ranks[place])
        both = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
        return both >> 20, both & 0xFFFFF


def _lists(values: np.ndarray, lengths: np.ndarray, of: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values, of))


def _four_bytes(ids: np.ndarray) -> np.ndarray:
    """UTF-8 of the tokens' characters, one row of four bytes each."""
    c = ids.astype(np.uint32) + PLACE
    return np.stack([0xF0 | c >> 18, 0x80 | c >> 12 & 63, 0x80 | c >> 6 & 63, 0x80 | c & 63], axis=1).astype(np.uint8)


def _split_blocks(pattern: str, tokens: list[bytes | None], mergeable: list[bool], byte_ids: np.ndarray, limit: int):
    """One row for each block of documents: their ids and numbers of pieces; a code for each
    piece (a token id, or the number of tokens plus the word's index); the words' strings and
    the ranks of the tokens in them."""
    def run(batches):
        split = regex.compile(pattern).findall
        known = pa.array([t if t is not None else b"" for t in tokens], pa.large_binary())
        search = _Substrings(tokens, mergeable)

        def block(docs, counts, pieces):
            coded = pa.concat_arrays(pieces).dictionary_encode()
            words = coded.dictionary.cast(pa.large_binary())
            token = pc.index_in(words, value_set=known)
            other = np.asarray(token.is_null())
            code = pc.fill_null(token, 0).to_numpy(zero_copy_only=False).astype(np.int32)
            code[other] = len(tokens) + np.arange(int(other.sum()), dtype=np.int32)
            words = words.filter(pa.array(other))
            offsets = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))))
            raw = np.frombuffer(b"".join(words.to_pylist()), dtype=np.uint8)
            found = []
            for lo in range(0, len(words), SEARCH_WORDS):
                cut = offsets[lo:lo + SEARCH_WORDS + 1]
                found.append((lo, *search.find(raw[cut[0]:cut[-1]], cut - cut[0])))
            word = np.concatenate([lo + w for lo, w, _ in found]) if found else np.zeros(0, np.int64)
            rank = np.concatenate([r for _, _, r in found]) if found else np.zeros(0, np.int64)
            start = pa.StringArray.from_buffers(len(words), pa.py_buffer((offsets * 4).astype(np.int32)),
                                                pa.py_buffer(_four_bytes(byte_ids[raw]).reshape(-1).data))
            merges = _lists(rank, np.bincount(word, minlength=len(words)), pa.int32())
            cells = [pa.array(docs, pa.int64()), pa.array(counts, pa.int32()), pa.array(code[coded.indices.to_numpy()], pa.int32()), start, merges]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cells],
                                              ["doc_id", "n_pieces", "code", "words", "merges"])

        docs, counts, held, pieces, total = [], [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = split(text.as_py() or "")
                if docs and total + len(found) > limit:
                    yield block(docs, counts, [*pieces, pa.array(held, pa.large_string())])
                    docs, counts, held, pieces, total = [], [], [], [], 0
                docs.append(doc)
                counts.append(len(found))
                held += found
                total += len(found)
                if len(held) > 1 << 16:
                    pieces.append(pa.array(held, pa.large_string()))
                    held = []
        if docs:
            yield block(docs, counts, [*pieces, pa.array(held, pa.large_string())])
    return run


def _ids_of(size: int, limit: int = 1 << 20):
    """Rows (doc_id, ids) of the documents of a block."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, n, code, folded = (batch.column(c).slice(i, 1).flatten() for c in range(4))
                code, n = code.to_numpy(), n.to_numpy().astype(np.int64)
                lengths = pc.binary_length(folded).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                text = np.frombuffer("".join(folded.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
                table = np.concatenate([np.arange(size, dtype=np.int32), (text - PLACE).astype(np.int32)])
                first = np.concatenate([np.arange(size), size + np.cumsum(lengths) - lengths])
                count = np.concatenate([np.ones(size, dtype=np.int64), lengths])
                ends = np.concatenate(([0], np.cumsum(n)))
                lo = 0
                while lo < len(n):
                    hi = min(len(n), max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1))
                    c = code[ends[lo]:ends[hi]]
                    k = count[c]
                    upto = np.concatenate(([0], np.cumsum(k)))
                    ids = table[np.repeat(first[c] - upto[:-1], k) + np.arange(upto[-1])]
                    yield pa.RecordBatch.from_arrays(
                        [doc.slice(lo, hi - lo), _lists(ids, np.diff(upto[ends[lo:hi + 1] - ends[lo]]), pa.int32())], ["doc_id", "ids"])
                    lo = hi
    return run


def _folded(docs: DataFrame, vocabulary: Vocabulary, pattern: str, block_pieces: int) -> DataFrame:
    """Blocks of documents with the merged words."""
    mergeable = [p is not None for p in vocabulary.pairs]
    blocks = docs.mapInArrow(
        _split_blocks(pattern, vocabulary.tokens, mergeable, vocabulary.byte_ids, block_pieces),
        "doc_id array<long>, n_pieces array<int>, code array<int>, words array<string>, merges array<array<int>>")
    pair, char = vocabulary.literals()
    # The fold: of each word, its merges in the order of their ranks.
    return blocks.select("doc_id", "n_pieces", "code", F.zip_with("words", "merges", lambda word, ranks: F.aggregate(
        ranks, word, lambda w, rank: F.replace(w, F.get(pair, rank), F.get(char, rank)))).alias("folded"))


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per input row: doc_id and ids, the token ids of the whole text.

    A null or empty text has no ids.  Rows with a null doc_id and repeated rows are encoded
    as they come; an empty table gives no rows; extra columns are ignored.  A text is one unit
    of work of a task, whatever its length: its pieces are held at once, and a single piece of
    a million characters costs a few thousand replacements of its whole length.  Special tokens
    are ordinary text.
    """
    return _folded(text_only(docs, id_col, text_col), vocabulary, pattern, block_pieces).mapInArrow(
        _ids_of(len(vocabulary.tokens)), "doc_id long, ids array<int>")


def _bytes_of(ids: pa.ListArray, known: pa.Array) -> pa.Array:
    """The binary pieces of the tokens of each list, concatenated."""
    flat = ids.flatten()
    flat = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(known))), flat, pa.scalar(None, flat.type))
    pieces = pc.fill_null(known.take(flat), b"")
    cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))))
    whole = b"".join(pieces.to_pylist()) if pieces.offset else pieces.buffers()[2]
    whole = pa.py_buffer(b"") if whole is None else pa.py_buffer(whole)
    joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends[cuts].astype(np.int64)), whole])
    return pc.if_else(ids.is_null(), pa.scalar(None, pa.large_binary()), joined) if ids.null_count else joined


def _parts(batch: pa.RecordBatch, at: int, limit: int = 1 << 20):
    """Slices of a batch with about ``limit`` ids in list column ``at`` (one row at least)."""
    n = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.concatenate(([0], np.cumsum(n))), 0
    while lo < len(n):
        hi = min(len(n), max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _decode(tokens: list[bytes | None], at: int):
    def run(batches):
        known = pa.array(tokens, pa.large_binary())
        for batch in batches:
            for part in _parts(batch, at):
                out = _bytes_of(part.column(at), known).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*(f"c{i}" for i in range(part.num_columns)), "decoded"])
    return run


def _report(tokens: list[bytes | None]):
    def run(batches):
        known = pa.array(tokens, pa.large_binary())
        number = pa.array([str(i) for i in range(len(tokens))], pa.large_string())
        for batch in batches:
            for part in _parts(batch, 1):
                ids = part.column(1)
                cuts = np.asarray(ids.offsets).astype(np.int64)
                digits = pa.LargeListArray.from_arrays(pa.array(cuts - cuts[0]), number.take(ids.flatten()))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pc.list_value_length(ids).cast(pa.int64()),
                    pa.array([sha256(x.as_buffer()).hexdigest() for x in pc.binary_join(digits, pa.scalar(",", pa.large_string()))], pa.string()),
                    pa.array([sha256(x.as_buffer()).hexdigest() for x in _bytes_of(ids, known)], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with a binary column of the bytes that the ids stand for.  Ids beyond the
    vocabulary (and null ids) stand for nothing; no ids give empty bytes, null ids null."""
    rows = encoded.withColumn(ids_col, F.col(ids_col).cast("array<int>"))
    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.BinaryType())])
    return rows.mapInArrow(_decode(vocabulary.tokens, rows.columns.index(ids_col)), schema)


def token_report(docs: DataFrame, vocabulary: Vocabulary, pattern: str, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256 (the bytes decoded from the ids).  Encodes, decodes and digests in one step
    of the same worker: no table of ids is written or sent on."""
    ids, report = _ids_of(len(vocabulary.tokens)), _report(vocabulary.tokens)
    return _folded(text_only(docs), vocabulary, pattern, block_pieces).mapInArrow(
        lambda batches: report(ids(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
