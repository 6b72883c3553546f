"""Packing documents into batches of a token budget, in length buckets that minimise padding.

1. The global histogram of lengths, in bins exact up to ``2**BIN_BITS`` tokens and within a
   fraction ``2**-BIN_BITS`` above, with the longest length in each bin, is the only thing collected: its size is bounded by the bits of
   a length, not by rows.
2. Dynamic programming over the bins chooses at most ``buckets`` boundaries with the least total
   padding, every document being padded to the longest length its bucket admits.
3. A bucket is cut into shards of about ``SHARD_ROWS`` rows by a hash, so no bucket lands in one
   task; inside a shard rows are ordered by hash and fill batches of budget // bound rows. A
   document longer than the budget is a batch of its own.

Tokens are words, ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none, take no batch (batch null, bucket -1)
and stay in the result. Ties go by hash, then doc_id. Texts of any length are counted, one longer than the budget fills a batch. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.mixing import word_count
from siteloom.session import cut_lineage

BUCKETS, BUDGET, BIN_BITS, SHARD_ROWS = 16, 16_384, 8, 2000


def length_bin(length: Column) -> Column:
    """Largest length that counts as the same: exact up to 2**BIN_BITS, rounded up in the last bits above."""
    shift = F.greatest(F.length(F.bin(length)) - BIN_BITS, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return F.ceil(length / unit) * unit


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` groups of the ascending lengths with the least padding.

    cost(i, j) pads lengths i..j to lengths[j]. Costs obey the quadrangle inequality, so the best
    last split never moves left and each layer is solved by divide and conquer.
    """
    n = len(lengths)
    if not n:
        return lengths
    many = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    total = np.concatenate([[0.0], np.cumsum(lengths.astype(np.float64) * counts)])
    best = lengths * many[1:] - total[1:]  # one bucket
    back = []
    for _ in range(min(buckets, n) - 1):
        now, split = np.full(n, np.inf), np.zeros(n, np.int64)
        todo = [(0, n - 1, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j) + 1)  # the last bucket is i..j
            cost = np.where(i > 0, best[i - 1], 0.0) + lengths[j] * (many[j + 1] - many[i]) - (total[j + 1] - total[i])
            k = int(np.argmin(cost))
            now[j], split[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        back.append(split)
        best = now
    bounds, j = [], n - 1
    for split in reversed(back):
        bounds.append(j)
        j = int(split[j]) - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(j)
    return lengths[np.array(sorted(bounds))]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_bound, batch, place, padding) per row of ``docs`` (doc_id, text).

    batch is bucket-shard-number; place counts rows inside the batch from 0.
    """
    rows = cut_lineage(docs.select("doc_id", word_count().alias("n_tokens"), F.xxhash64("doc_id", F.xxhash64("text")).alias("_h")))
    hist = rows.where("n_tokens > 0").groupBy(length_bin(F.col("n_tokens")).alias("bin")).agg(F.max("n_tokens"), F.count("*")).orderBy("bin").collect()
    lengths, counts = np.array([r[1] for r in hist], np.int64), np.array([r[2] for r in hist], np.int64)  # a bin's bound is its longest member
    bounds = bucket_bounds(lengths, counts, buckets)
    ends = np.searchsorted(lengths, bounds, "right")
    sizes = np.diff(np.concatenate([[0], np.cumsum(counts)[ends - 1]])) if len(bounds) else []
    bucket, bound, shards = F.lit(-1), F.lit(0).cast("long"), F.lit(1)
    for k in range(len(bounds) - 1, -1, -1):
        inside = F.col("n_tokens").between(1, int(bounds[k]))
        bucket, bound = F.when(inside, k).otherwise(bucket), F.when(inside, int(bounds[k])).otherwise(bound)
        shards = F.when(inside, int(-(-sizes[k] // SHARD_ROWS))).otherwise(shards)
    shard = F.pmod("_h", shards)
    rows = rows.select("*", bucket.alias("bucket"), bound.alias("bucket_bound"), shard.alias("_shard"))
    filled = rows.where("bucket >= 0").withColumn("_nth", F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy("_h", "doc_id", "n_tokens")) - 1)
    most = F.greatest(F.floor(F.lit(budget) / F.col("bucket_bound")), F.lit(1))
    number = F.floor(F.col("_nth") / most)
    filled = filled.select("doc_id", "n_tokens", "bucket", "bucket_bound", F.concat_ws("-", "bucket", "_shard", number.cast("long")).alias("batch"), (F.col("_nth") - number * most).cast("long").alias("place"), (F.col("bucket_bound") - F.col("n_tokens")).alias("padding"))
    none = rows.where("bucket < 0").select("doc_id", "n_tokens", "bucket", "bucket_bound", F.lit(None).cast("string").alias("batch"), F.lit(None).cast("long").alias("place"), F.lit(0).cast("long").alias("padding"))
    return filled.unionByName(none)
