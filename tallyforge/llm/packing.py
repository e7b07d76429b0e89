"""Packing: optimal length buckets, then token-budget batches inside each bucket.

Document length is the number of words (runs of anything but ASCII white space), or any integer column.
The global histogram of lengths has exact cells below 512 and cells of 1/256 relative width above, so at
most a few thousand cells reach the driver whatever the corpus. A cell's limit is its longest document. Dynamic
programming over the cells chooses the `buckets` upper bounds that minimise total padding among these
limits: of all bounds up to 512 words, of those that split no cell above.

In a bucket of padded length L a batch holds max(1, budget // L) documents. Rows of a bucket are dealt by
a hash of the document over shards of about `shard_rows`, so no task gets a whole bucket; each shard fills
its batches in hash order and leaves one batch part-full at most.

Defined cases: null or blank texts have length 0 and share the first bucket (padded to 1 at least); a
document over the budget has a batch of its own, whole; rows that repeat in full are packed each; null
doc_ids are packed like others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 16
TOKEN_BUDGET = 16384
SHARD_ROWS = 20000
EXACT = 512


def n_words(text: Column) -> Column:
    """Words of a text, counted without building them: null and blank texts have none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long")


def cell_of(length: Column) -> Column:
    """Upper limit of the histogram cell that holds a length: itself under EXACT, else at most 1/256 more."""
    step = F.expr("1L").cast("long")
    bits = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    step = F.when(length < EXACT, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2.0), F.greatest(bits - 8, F.lit(0))).cast("long"))
    return (F.ceil(length / step) * step).cast("long")


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(longest length, documents, tokens) of each cell in order; bounded by the number of cells."""
    rows = (
        lengths.groupBy(cell_of(F.col("n_tokens")).alias("cell")).agg(F.max("n_tokens").alias("longest"), F.count("*").alias("n"), F.sum("n_tokens").alias("t")).toPandas().sort_values("cell")
    )
    return rows["longest"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["t"].to_numpy(np.int64)


def best_bounds(cells: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets over sorted cells, of least total padding."""
    m = len(cells)
    if not m:
        return [1]
    k = min(buckets, m)
    upto = np.concatenate(([0], count.cumsum())).astype(np.float64)
    limit = np.maximum(cells, 1).astype(np.float64)
    cost = limit * upto[1:]  # one bucket over cells 0..j
    choice = np.zeros((k, m), np.int64)
    for b in range(1, k):
        new = np.empty(m)
        for j in range(m):
            # the last bucket holds cells i..j
            total = np.concatenate(([limit[j] * upto[j + 1]], cost[:j] + limit[j] * (upto[j + 1] - upto[1 : j + 1])))
            choice[b, j] = total.argmin()
            new[j] = total[choice[b, j]]
        cost = new
    bounds, j = [], m - 1
    for b in range(k - 1, -1, -1):
        bounds.append(int(limit[j]))
        j = int(choice[b, j]) - 1
        if j < 0:
            break
    return sorted(set(bounds))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, shard_rows: int = SHARD_ROWS, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_to, shard, batch, slot: one row per document.

    (bucket, shard, batch) names a batch; slot counts from 0 in it.
    """
    lengths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (n_words(F.col("text")) if length is None else length.cast("long")).alias("n_tokens"), F.xxhash64("doc_id", "text").alias("deal"))
    src = materialize(lengths, "packing-lengths")  # texts are read once
    cells, count, _ = histogram(src)
    bounds = best_bounds(cells, count, buckets)
    held = np.zeros(len(bounds), np.int64)
    np.add.at(held, np.searchsorted(bounds, np.maximum(cells, 1)), count)
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], i).otherwise(bucket)
    at = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("bucket"))
    shards = [max(1, math.ceil(int(n) / shard_rows)) for n in held]
    dealt = src.withColumn("bucket", bucket.cast("int")).select(
        "doc_id", "n_tokens", "deal", "bucket", at([int(b) for b in bounds]).cast("long").alias("padded_to"), F.pmod("deal", at(shards).cast("long")).cast("int").alias("shard")
    )
    order = Window.partitionBy("bucket", "shard").orderBy("deal", "doc_id")
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("padded_to"))).cast("long")
    nth = (F.row_number().over(order) - 1).cast("long")
    return dealt.withColumn("nth", nth).select(
        "doc_id", "n_tokens", "bucket", "padded_to", "shard", F.floor(F.col("nth") / room).cast("long").alias("batch"), (F.col("nth") % room).cast("int").alias("slot")
    )
