"""Line deduplication over levelled sorted runs of line hashes (operator 5).

``LineRuns`` holds one row per line key and run: (h1, h2, n_docs, holder), sorted by the
hash.  A batch is joined with the runs once: keys that no run has (an anti join) enter the
batch's own run with the largest doc_id that holds them, known keys only with their count.
When a level has ``fanout`` runs they are merged into one run of the next level, so a key
is rewritten a logarithmic number of times and a batch meets few runs.  Batches come in
descending order of doc_id, so a key's holder is fixed when the key is first seen.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealgrid.llm.common import BROADCAST_BYTES, text_only, written

MIN_CHARS = 40
MIN_DOCS = 5
KEY_BYTES = 40  # of a frequent key in a broadcast
HOT_SHARE = 1 << 16
BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    """The key of a line: stripped of blanks at both ends, A-Z lower-cased."""
    return line.strip(BLANK).translate(_LOWER)


def line_hash(line: bytes, min_chars: int) -> tuple[int, int] | None:
    """128-bit hash of a line's key, None if it has under ``min_chars`` code points."""
    key = line_key(line)
    if len(key) < min_chars or len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return struct.unpack("<qq", hashlib.blake2b(key, digest_size=16).digest())


def _line_rows(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, h1, h2 = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not t.is_valid:
                    continue
                found = {line_hash(x, min_chars) for x in t.as_buffer().to_pybytes().split(b"\n")} - {None}
                ids += [i] * len(found)
                for a, b in found:
                    h1.append(a)
                    h2.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, h1, h2)], ["doc_id", "h1", "h2"])
    return run


class LineRuns:
    """Levels of sorted runs of line keys."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> DataFrame | None:
        """All runs as one frame (several rows a key: one for each run that has it)."""
        found = [r for level in self.levels for r in level]
        out = found[0] if found else None
        for r in found[1:]:
            out = out.unionByName(r)
        return out

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*_RUN).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def _run(self, rows: DataFrame) -> DataFrame:
        return written(rows.repartition(*_RUN).sortWithinPartitions(*_RUN), "line-run")

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of distinct (doc_id, h1, h2)."""
        batch = lines.groupBy(*_RUN).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        held = self.runs()
        if held is not None:
            batch = written(batch, "line-batch")
            keys = held.select(*_RUN)
            fresh = batch.join(keys, _RUN, "left_anti")
            known = batch.join(keys, _RUN, "left_semi").withColumn("holder", F.lit(None).cast("long"))
            batch = fresh.unionByName(known)
        self.levels[0].append(self._run(batch))
        self._compact()

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                rows = level[0]
                for r in level[1:]:
                    rows = rows.unionByName(r)
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._run(self._merged(rows)))
                self.levels[i] = []

    def counted(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, holder) of the keys held by ``min_docs`` documents or more."""
        return written(self._merged(self.runs()).where(F.col("n_docs") >= min_docs), "line-frequent")

    def frequent(self, min_docs: int) -> DataFrame:
        """``counted`` without the counts: (h1, h2, holder)."""
        return self.counted(min_docs).select(*_RUN, "holder")


def _held(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, holder): the lines with a frequent key.  Few frequent keys are broadcast.  Of more,
    those that hold 1/HOT_SHARE of all such lines or more, of which there can be only
    HOT_SHARE, are broadcast, and the lines of all others meet their keys in a shuffle join: no
    partition of it gets a hot key."""
    cols = ["doc_id", *_RUN, "holder"]
    keys, rows = frequent.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    if keys * KEY_BYTES <= BROADCAST_BYTES:
        return lines.join(F.broadcast(frequent), _RUN).select(*cols)
    is_hot = F.col("n_docs") >= -(-rows // HOT_SHARE)
    hot, cold = frequent.where(is_hot), frequent.where(~is_hot)
    rest = lines.join(F.broadcast(hot.select(*_RUN)), _RUN, "left_anti")
    return lines.join(F.broadcast(hot), _RUN).select(*cols).unionByName(rest.join(cold.hint("merge"), _RUN).select(*cols))


def _losses(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(loss_id, loss_keys): the line hashes that each document loses."""
    src = text_only(docs)
    lines = src.mapInArrow(_line_rows(min_chars), "doc_id long, h1 long, h2 long").distinct()
    cuts = sorted({int(x) for x in (src.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] or [])})
    number = F.lit(0)
    for c in cuts:  # batch 0 has the largest ids
        number = number + F.when(F.col("doc_id") <= c, 1).otherwise(0)
    all_lines = written(lines.withColumn("batch", number), "lines")
    runs = LineRuns(docs.sparkSession)
    for i in range(len(cuts) + 1):
        runs.add(all_lines.where(F.col("batch") == i).select("doc_id", "h1", "h2"))
    frequent = runs.counted(min_docs)
    return (_held(all_lines, frequent).where("doc_id <> holder")
            .groupBy(F.col("doc_id").alias("loss_id")).agg(F.collect_list(F.struct(*_RUN)).alias("loss_keys")))


def _kept(text: bytes, losses: set, min_chars: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    keep = [x for x in lines if line_hash(x, min_chars) not in losses] if losses else lines
    return len(lines), len(lines) - len(keep), b"\n".join(keep)


def _judge(text_at: int, min_chars: int, replace: bool):
    """The last column holds the lost keys; the text is replaced, or digested."""
    def run(batches):
        for batch in batches:
            names, last = batch.schema.names, batch.num_columns - 1
            found = []
            for t, x in zip(batch.column(text_at), batch.column(last).to_pylist()):
                if replace and not x:
                    found.append(None)
                    continue
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                found.append(_kept(raw, {(y["h1"], y["h2"]) for y in x or ()}, min_chars))
            if replace:
                texts = pa.array([t.as_py() if f is None else f[2].decode("utf-8", "replace")
                                  for t, f in zip(batch.column(text_at), found)], pa.string())
                cols = [texts if i == text_at else batch.column(i) for i in range(last)]
                yield pa.RecordBatch.from_arrays(cols, names[:last])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                     pa.array([hashlib.sha256(f[2]).hexdigest() for f in found], pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
    return run


def line_dedup_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4) -> DataFrame:
    """One row per input row: doc_id, n_lines (before), n_dropped, kept_sha256 (of the kept lines).

    Lines with a key of ``min_chars`` code points or more that ``min_docs`` documents hold
    are dropped except in the largest doc_id that holds them.  A null text is one empty line.
    Rows with a null doc_id are not counted and lose nothing.  Rows that share a doc_id
    count as one document.  An empty table gives no rows; extra columns are ignored.
    """
    src = text_only(docs)
    joined = src.join(_losses(docs, min_chars, min_docs, batches), F.col("doc_id") == F.col("loss_id"), "left")
    return joined.select("doc_id", "text", "loss_keys").mapInArrow(
        _judge(1, min_chars, False), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4) -> DataFrame:
    """``docs`` (columns doc_id, text and any others, kept as they are) with the dropped
    lines cut out of the text; rules as in ``line_dedup_report``.  No row is dropped."""
    losses = _losses(docs, min_chars, min_docs, batches)
    cols = docs.columns
    joined = docs.join(losses.select(F.col("loss_id").alias("__loss_id"), F.col("loss_keys").alias("__loss_keys")),
                       F.col("doc_id").cast("long") == F.col("__loss_id"), "left").select(*cols, "__loss_keys")
    return joined.mapInArrow(_judge(cols.index("text"), min_chars, True), docs.schema)
