"""URL filter rules behind a blocked Bloom filter (operator 2).

A listed rule is a canonical ``host + path`` string with a verdict.  It fits its host and all
subdomains if the url's path starts with the rule's path; the longest rule wins.  For a
url all ``parent host + path prefix`` strings of the listed path lengths are looked up in a
blocked Bloom filter (one 64-byte block a key); what it passes goes to an exact hash join
with the rules, which removes false positives.  The filter has a fixed largest size: it
can be broadcast however long the list is, and only its rate of false hits grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

BITS_PER_RULE = 16
MAX_BYTES = 16 << 20
PROBES = 6
_BLOCK = 8  # 64-bit words of a block

# The registered query's rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lower-cased; path from
    there up to ? or #.  Both empty if the url is null or has no ://."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
    path = rest[end:]
    return host, path[:min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Rule strings that could fit: each parent host with each prefix of a listed length."""
    if not host:
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return [h + path[:k] for h in hosts for k in lengths if k <= len(path)]


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _positions(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its PROBES bits inside the block (512 bits)."""
    h = h.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    low = h * np.uint64(0x9E3779B97F4A7C15)
    bits = np.stack([(low >> np.uint64(9 * i)) & np.uint64(511) for i in range(PROBES)])
    return block.astype(np.int64), bits


def bloom(rules: DataFrame, keys: str = "key") -> tuple[np.ndarray, int]:
    """The filter's words (built on the executors; its size is bounded by MAX_BYTES)."""
    n = rules.count()
    blocks = int(min(MAX_BYTES // 64, max(1, -(-n * BITS_PER_RULE // 512))))

    def words(batches):
        for batch in batches:
            block, bits = _positions(np.asarray(batch.column(0)), blocks)
            at = (block * _BLOCK + (bits >> np.uint64(6)).astype(np.int64)).ravel()
            bit = (np.uint64(1) << (bits & np.uint64(63))).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bit)], ["at", "bit"])

    found = rules.select(F.xxhash64(keys).alias("h")).mapInArrow(words, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("word"))
    out = np.zeros(blocks * _BLOCK, dtype=np.uint64)
    table = found.toArrow()
    out[table.column("at").to_numpy()] = table.column("word").to_numpy().view(np.uint64)
    return out, blocks


def _parse(lengths: list[int]):
    def run(batches):
        for batch in batches:
            host, path, keys = [], [], []
            for u in batch.column(1).to_pylist():
                h, p = split_url(u)
                host.append(h)
                path.append(p)
                keys.append(candidates(h, p, lengths))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(host, pa.string()), pa.array(path, pa.string()),
                 pa.array(keys, pa.list_(pa.string()))], ["page_id", "url", "copies", "host", "path", "keys"])
    return run


def _possible(shared, blocks: int):
    def run(batches):
        words = shared.value
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1)
            flat = np.asarray(hashes.flatten())
            block, bits = _positions(flat, blocks)
            hit = np.ones(len(flat), dtype=bool)
            for b in bits:
                hit &= (words[block * _BLOCK + (b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
            counts = np.asarray(pa.compute.list_value_length(hashes).fill_null(0))
            ends = np.concatenate(([0], np.cumsum(counts)))
            keys = batch.column(5).flatten()
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(hit)))[ends], pa.int32()), keys.filter(pa.array(hit)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], kept], batch.schema.names[:6])
    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per input row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    ``rules``: host, path, verdict; a rule listed twice with both verdicts blocks.  rule is null
    and verdict is ``default`` if no rule fits (always so for null urls, urls without :// or an
    empty host).  Null page_ids and repeated rows are kept as they come; an empty list or table
    works; extra columns are ignored.
    """
    spark = pages.sparkSession
    listed = (rules.where("host is not null and path is not null and verdict is not null")
              .select(F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("k"))
              .groupBy("key").agg(F.max("verdict").alias("rule_verdict"), F.max("k").alias("k")))
    lengths = sorted(r[0] for r in listed.select("k").distinct().collect())  # at most the longest path
    words, blocks = bloom(listed)
    shared = spark.sparkContext.broadcast(words)
    # Equal rows are one row with a count: a page that is listed often is judged once.
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).groupBy(
        "page_id", "url").agg(F.count("*").alias("copies"))
    parsed = urls.mapInArrow(_parse(lengths), "page_id long, url string, copies long, host string, path string, keys array<string>")
    hashed = parsed.withColumn("hashes", F.transform("keys", lambda x: F.xxhash64(x)))
    possible = hashed.mapInArrow(_possible(shared, blocks), parsed.schema)
    hits = possible.select("page_id", "url", "copies", "host", "path", F.explode_outer("keys").alias("key"))
    best = hits.join(listed.select("key", "rule_verdict"), "key", "left").groupBy("page_id", "url").agg(
        F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length("key").alias("n"), "key", "rule_verdict"))).alias("won"))
    return best.select("page_id", "host", "path", F.col("won.key").alias("rule"),
                       F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict"),
                       F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).drop("__copy")
