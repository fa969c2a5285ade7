"""Quality rules as a bitmask ledger (operator 10).

Every rule is evaluated once per document: the ledger row holds the measurements and one
bit per failed rule.  A policy is a named, versioned set of rules (a mask): applying one,
or asking what a rule costs, is a bitwise operation on the ledger and never reads a text
again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dealgrid.llm.common import text_only
from dealgrid.llm.text import _SPACE, spans, text_buffer, windows, word_hashes

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b" \t\n\x0b\x0c\r"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

# Rule name -> SQL condition on the measurements under which a document fails.  The
# position is the bit: new rules go to the end, so old ledgers and masks stay valid.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
}

POLICIES = {
    "base-1": ["few_words", "repeated_windows"],
    "strict-1": ["few_words", "repeated_windows", "symbols", "short_words", "long_words", "repeated_lines"],
}


def mask_of(rules: list[str]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeats(shingles: np.ndarray) -> int:
    """Words in windows of 3 that occur twice or more, from a text's windows in order."""
    if len(shingles) < 2:
        return 0
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s) + 1, dtype=bool)
    twice[1:-1] = same
    hit = np.zeros(len(s) + 2, dtype=bool)
    at = order[twice[:-1] | twice[1:]]
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def _measure(batches):
    for batch in batches:
        n = batch.num_rows
        out = {m: np.zeros(n, dtype=np.int64) for m in MEASURES}
        column = batch.column(1)
        for lo, hi, hashes, counts in word_hashes(column, "cased"):
            out["n_words"][lo:hi] = counts
            grams, number = windows(hashes, counts, 3)
            at = 0
            for i, (k, c) in enumerate(zip(number.tolist(), counts.tolist())):
                if c >= 4:
                    out["n_repeat_words"][lo + i] = _repeats(grams[at:at + k])
                at += k
        raw, off = text_buffer(column)
        for lo, hi in spans(off):
            part, cut = raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
            for name, mask in (("n_symbols", _SYMBOL[part]), ("word_chars", ~_SPACE[part] & ((part & 0xC0) != 0x80))):
                total = np.concatenate(([0], np.cumsum(mask)))
                out[name][lo:hi] = total[cut[1:]] - total[cut[:-1]]
        for i, t in enumerate(column):
            if t.is_valid:
                lines = [x for x in t.as_buffer().to_pybytes().split(b"\n") if x.strip(_BLANK)]
                out["n_lines"][i] = len(lines)
                out["n_dup_lines"][i] = len(lines) - len(set(lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[m]) for m in MEASURES]], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the measurements, fail_bits (bit i: rule i failed).

    A null, empty or blank text has no words and all measurements 0; it fails few_words
    alone.  Null doc_ids and repeated rows are kept as they come; extra columns are ignored.
    """
    measured = text_only(docs).mapInArrow(_measure, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, only): documents that fail each rule of a policy, and those that the
    policy would keep without it.  One aggregation over at most 2^rules bit patterns."""
    mask = mask_of(POLICIES[policy])
    seen = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("docs"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("long").alias("bit")) for r in POLICIES[policy]])
    return (seen.select("bits", "docs", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("docs")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("docs")).otherwise(0)).alias("only")))


def quality_report(docs: DataFrame, policy: str = "strict-1") -> DataFrame:
    """Ledger rows with base_failed (a base rule failed) and kept (the policy's verdict)."""
    return (ledger(docs).withColumn("base_failed", ~passes("base-1"))
            .withColumn("kept", passes("base-1") & passes(policy)))
