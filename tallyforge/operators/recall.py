"""Recall: the m experiences whose source query shares most words with a target query.

An exact top-m set-similarity search. Experiences are dealt into shards of a bounded number of words; a shard's
index is broadcast, every target asks it where it lies, and its best m are all that is emitted. Within a shard the
words are ordered by how many experiences hold them:

* rare words have posting lists, which give each experience met its part of the intersection;
* words that more than one experience in `STOP_SHARE` holds have no postings but a bit in each experience. They
  are resolved last, by an AND of bits, for those alone whose bound (rare part, and all common words that both could
  share) reaches the m-th score so far;
* experiences that no rare word meets are bounded by their size and their number of common words. Sizes and numbers recur, so
  bounds are taken for each such class once, and only members of classes that reach the m-th score are looked at.

A prefix filter over a join of words, the usual way, prunes little here: at sf0.1 the fifth score is 0.059 (median), and even if it were known
beforehand, the prefixes that it allows meet in 0.6 million rows for 0.36 million pairs of 2.0 million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..storage import written

#: (requests, experiences, m) -> (target_query_id, experience_id, recall_score, recall_rank), as recall_top_m.
Recall = Callable[[DataFrame, DataFrame, int], DataFrame]

#: Words of a shard, about; its index takes some 30 bytes for each. One is broadcast and searched at a time.
SHARD_WORDS = 1 << 21
#: A word that more than one experience in so many holds is common.
STOP_SHARE = 16
_ROWS = 1024
_FOUND = "target_query_id string, experience_id string, recall_score double"


def build_shard(ids: pa.Array, sets: pa.ListArray) -> dict:
    """Index of experiences (id, distinct words); numbers follow the order of ids, so ties go to the smaller number."""
    order = pc.sort_indices(ids)
    ids, sets = ids.take(order), sets.take(order)
    n, size = len(ids), np.asarray(pc.list_value_length(sets), np.int64)
    coded = pc.dictionary_encode(sets.flatten())
    code, owner = np.asarray(coded.indices, np.int64), np.repeat(np.arange(n), size)
    held = np.bincount(code, minlength=len(coded.dictionary))
    common = held * STOP_SHARE > n
    bit = np.where(common, common.cumsum() - 1, -1)
    is_common = common[code]
    bits = np.zeros((n, -(-int(common.sum()) // 64)), np.uint64)
    at = bit[code[is_common]]
    np.bitwise_or.at(bits, (owner[is_common], at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
    rare_code, rare_owner = code[~is_common], owner[~is_common]
    by_word = np.argsort(rare_code, kind="stable")
    stops = np.bincount(owner[is_common], minlength=n)
    classes, cls = np.unique(np.stack((size, stops), axis=1), axis=0, return_inverse=True)
    cls = cls.ravel()
    return {
        "ids": ids, "vocab": coded.dictionary, "size": size, "stops": stops, "bit": bit, "bits": bits, "posts": rare_owner[by_word].astype(np.int32), "start": np.searchsorted(rare_code[by_word], np.arange(len(held) + 1)),
        "class_size": classes[:, 0], "class_stops": classes[:, 1], "members": np.argsort(cls, kind="stable"), "member_start": np.searchsorted(np.sort(cls), np.arange(len(classes) + 1)),
        "blank": np.flatnonzero(size == 0),
    }


def _score(shared: np.ndarray, nt: int, size: np.ndarray) -> np.ndarray:
    return shared / np.maximum(nt + size - shared, 1)


def _mth(scores: np.ndarray, m: int) -> float:
    return float(np.partition(scores, len(scores) - m)[len(scores) - m]) if len(scores) >= m else 0.0


def search_shard(shard: dict, codes: np.ndarray, nt: int, m: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, scores) of the m best, best first, and how many experiences were looked at. codes: the target's words that the shard has."""
    n = len(shard["size"])
    if nt == 0:  # two empty sets are equal
        first = np.unique(np.concatenate((shard["blank"][:m], np.arange(min(n, m)))))
        score = (shard["size"][first] == 0).astype(float)
        best = np.lexsort((first, -score))[:m]
        return first[best], score[best], len(first)
    at = shard["bit"][codes]
    mine = np.zeros(shard["bits"].shape[1], np.uint64)
    set_bits = at[at >= 0]
    np.bitwise_or.at(mine, set_bits // 64, np.uint64(1) << (set_bits % 64).astype(np.uint64))
    k = len(set_bits)

    def common_of(e: np.ndarray) -> np.ndarray:
        return np.bitwise_count(shard["bits"][e] & mine).sum(1, dtype=np.int64)

    start = shard["start"]
    lists = [shard["posts"][start[c] : start[c + 1]] for c in codes[at < 0]]
    met, part = np.unique(np.concatenate([*lists, np.zeros(0, np.int32)]), return_counts=True)
    floor = _mth(_score(part, nt, shard["size"][met]), m)
    may = _score(part + np.minimum(k, shard["stops"][met]), nt, shard["size"][met]) >= floor
    near, part = met[may], part[may]
    shared = part + common_of(near)
    score = _score(shared, nt, shard["size"][near])
    floor = _mth(score, m)
    most = np.minimum(k, shard["class_stops"])
    more = np.flatnonzero((most > 0) & (_score(most, nt, shard["class_size"]) >= floor))
    seen = len(near)
    if len(more):
        rest = np.concatenate([shard["members"][shard["member_start"][c] : shard["member_start"][c + 1]] for c in more])
        rest = np.setdiff1d(rest, met, assume_unique=True)
        got = common_of(rest)
        seen += len(rest)
        rest, got = rest[got > 0], got[got > 0]
        near, score = np.concatenate((near, rest)), np.concatenate((score, _score(got, nt, shard["size"][rest])))
    if len(near) < m:  # all that share a word are there; the least ids of the others follow
        none = np.setdiff1d(np.arange(min(n, m + len(near))), near)[: m - len(near)]
        near, score = np.concatenate((near, none)), np.concatenate((score, np.zeros(len(none))))
    best = np.lexsort((near, -score))[:m]
    return near[best], score[best], seen


def _ask(sent, m: int):
    """Best m of a broadcast shard for each row (target_query_id, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                b = batch.slice(lo, _ROWS)
                w = b.column("w")
                known = pc.fill_null(pc.index_in(w.flatten(), value_set=shard["vocab"]), -1).to_numpy(zero_copy_only=False)
                size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
                end = size.cumsum()
                found = []
                for i, nt in enumerate(size.tolist()):
                    codes = known[end[i] - nt : end[i]]
                    found.append(search_shard(shard, codes[codes >= 0], nt, m))
                which = np.repeat(np.arange(b.num_rows), [len(f[0]) for f in found])
                numbers = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                scores = np.concatenate([f[1] for f in found]) if found else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column("target_query_id").take(pa.array(which)), shard["ids"].take(pa.array(numbers)), pa.array(scores, pa.float64())], names=["target_query_id", "experience_id", "recall_score"])

    return run


def _plain(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def shard_count(experiences: DataFrame, shard_words: int) -> int:
    """Shards that (experience_id, v) are dealt into, of about shard_words words each."""
    total = experiences.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("w")).first()
    return -(-max(total["n"], total["w"] or 0) // shard_words)


def read_shard(experiences: DataFrame, number: int, count: int) -> dict | None:
    """Index of the experiences whose id's hash says so."""
    part = experiences.where(F.pmod(F.xxhash64("experience_id"), F.lit(count)) == number).select("experience_id", "v").toArrow()
    return build_shard(_plain(part.column("experience_id")), _plain(part.column("v"))) if part.num_rows else None


def recall_top_m(requests: DataFrame, experiences: DataFrame, m: int = 5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(target_query_id, experience_id, recall_score, recall_rank), ranks 1..m; ids of targets are unique.

    Experiences without a shared word have a score of zero and rank by their id; experiences
    without words match targets without words fully. Experiences' words are written once, then read for the shards;
    targets' words are cut once, or written too where there are several shards to ask.
    """
    if m < 1:
        raise ValueError("m must be at least 1")
    spark = requests.sparkSession
    # exploding one array makes it a column, which is then read twice; otherwise words would be cut twice
    cut = lambda c: F.explode(F.array(words(F.col(c))))
    e = written(experiences.select("experience_id", cut("source_query").alias("v")), "recall-words")
    t = requests.select("target_query_id", cut("target_query").alias("w"))
    count = shard_count(e, shard_words)
    if count > 1:
        t = written(t, "recall-targets")
    found = None
    for i in range(count):
        shard = read_shard(e, i, count)
        if shard is None:
            continue
        sent = spark.sparkContext.broadcast(shard)
        part = t.mapInArrow(_ask(sent, m), _FOUND)
        if count > 1:  # the best so far are kept and the shard goes, so executors never hold two
            part = written(rank_best(part if found is None else found.unionAll(part), m).drop("recall_rank"), "recall-best")
            sent.destroy()
        found = part
    if found is None:
        found = spark.createDataFrame([], _FOUND)
    return rank_best(found, m)


def rank_best(pairs: DataFrame, m: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("target_query_id").orderBy(F.desc("recall_score"), "experience_id"))
    return pairs.withColumn("recall_rank", rank).where(F.col("recall_rank") <= m)


def rank_scored(pairs: DataFrame, m: int = 5) -> DataFrame:
    """Top m of (target_query_id, experience_id, recall_score) from any other scorer; scores must lie in [0, 1]."""
    checked = F.when((F.col("recall_score") >= 0) & (F.col("recall_score") <= 1), F.col("recall_score")).otherwise(F.raise_error(F.lit("recall_score must be in [0, 1]")).cast("double"))
    return rank_best(pairs.withColumn("recall_score", checked), m)
