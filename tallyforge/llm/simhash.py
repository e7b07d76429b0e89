"""Near-duplicate documents by SimHash, compared bit-sliced.

Fingerprints: words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lower-cased; features are all
3-word shingles (repeats count), or the whole word sequence where it has fewer words; each votes with
its XXH64 (seed 42), and a fingerprint bit is set if more than half of the votes set it.

Linking is exact for every pair of distinct fingerprints within the radius. With radius 2, two of four
16-bit blocks agree, so six tables of 32-bit keys find every pair. A key held by more than
`hot` fingerprints is dealt anew by two of four 8-bit blocks of its other 32 bits; such a group can hold
no more than 2**16 distinct fingerprints whatever the data. Within a group, bit planes are stored
vertically in words of 64 lanes; a row's distances to 64 others at once are counted by carry-save
adders, and a word is abandoned once all its lanes exceed the radius. A group yields a spanning forest
of its links, never all pairs; components are joined from these.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; copies share one
fingerprint and are never paired with one another; rows with null doc_id get a component like all others
(null if no member has an id); a repeated doc_id gives one row for each of its rows; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize, scratch, with_text

RADIUS = 2
SEED = 42
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes. bytes.lower and bytes.split know ASCII only, as wanted."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= 3:
        spans = zip(starts[:-2].tolist(), ends[2:].tolist(), strict=True)
    else:
        spans = [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    votes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(votes), 65536):  # bounded memory for very long texts
        total += np.unpackbits(votes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(votes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; hashed: with text_hash, the XXH64 of the text, too."""
    more = ["text_hash"] if hashed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("t").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), *[b.column(c) for c in more]], names=["doc_id", "fp", *more])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"), *[F.xxhash64("text").alias(c) for c in more])
    return with_text(src).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS, block: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of rows of one group at a distance of at most radius (1 to 3).

    group must be sorted. Rows of a group fill lanes of 64-bit words; (row, word) tasks run in blocks.
    """
    n = len(fp)
    if n < 2:
        return
    new = np.concatenate(([True], group[1:] != group[:-1]))
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    g_of = np.cumsum(new) - 1
    words = (count + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words)[:-1]))
    n_words = int(words.sum())
    rank = np.arange(n) - start[g_of]
    lane_word = first_word[g_of] + rank // 64
    lane = (rank % 64).astype(np.uint64)
    planes = np.zeros((64, n_words), np.uint64)
    for k in range(64):
        np.bitwise_or.at(planes[k], lane_word, ((fp >> np.uint64(k)) & np.uint64(1)) << lane)
    used = np.zeros(n_words, np.uint64)
    np.bitwise_or.at(used, lane_word, np.uint64(1) << lane)
    row_of_word = np.zeros(n_words, np.int64)
    row_of_word[lane_word[::-1]] = (np.arange(n) - (rank % 64))[::-1]
    # a row meets the words from its own one on; only later lanes of its own word count
    todo = words[g_of] - rank // 64
    bounds = np.cumsum(todo)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + block, "right")))
        size = todo[at:to]
        rows = np.repeat(np.arange(at, to), size)
        word = lane_word[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size))
        own = word == lane_word[rows]
        later = np.where(own, ~((np.uint64(2) << lane[rows]) - np.uint64(1)), _ONES) & used[word]
        ones = np.zeros(len(rows), np.uint64)
        twos = ones.copy()
        over = ~later
        for k in range(64):
            mask = np.uint64(0) - ((fp[rows] >> np.uint64(k)) & np.uint64(1))
            x = planes[k][word] ^ mask
            carry = ones & x
            ones ^= x
            over |= twos & carry  # a fourth difference
            twos ^= carry
            if radius == 2:
                over |= twos & ones
            elif radius == 1:
                over |= twos
            if k % 8 == 7:
                alive = over != _ONES
                if not alive.all():
                    rows, word, ones, twos, over = rows[alive], word[alive], ones[alive], twos[alive], over[alive]
                    if not len(rows):
                        break
        if len(rows):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(hit)
            yield rows[r], row_of_word[word[r]] + c
        at = to


def spanning_forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Label of each of n rows: the least row that its links reach."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (nxt := label[label] != label).any():
                label[nxt] = label[label[nxt]]
    return label


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) sorted by key -> edges (u, v). Holds one group and one batch at most."""
    held: list[np.ndarray] = []

    def edges(key: np.ndarray, fp: np.ndarray):
        label = spanning_forest(len(fp), close_pairs(fp.view(np.uint64), key))
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[label[at]]), pa.array(fp[at])], names=["u", "v"])

    for b in batches:
        key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy()
        if held:
            key, fp = np.concatenate((held[0], key)), np.concatenate((held[1], fp))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on
        held = [key[cut:], fp[cut:]]
        if cut > 1:
            yield edges(key[:cut], fp[:cut])
    if held and len(held[0]) > 1:
        yield edges(*held)


def _edges_of(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_groups, "u long, v long")


def _bits(col, low: int, width: int):
    return F.shiftrightunsigned(col, low).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, hot: int = 4096) -> DataFrame:
    """Edges (u, v) of a spanning forest in each candidate group over a table of distinct fp."""
    fp = F.col("fp")
    tables = []
    for t, (a, b) in enumerate(combinations(range(4), 2)):
        rest = [k for k in range(4) if k not in (a, b)]
        low32 = _bits(fp, 16 * rest[0], 16).bitwiseOR(F.shiftleft(_bits(fp, 16 * rest[1], 16), 16))
        tables.append(F.struct(F.xxhash64(F.lit(t), _bits(fp, 16 * a, 16), _bits(fp, 16 * b, 16)).alias("key"), low32.alias("rest")))
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.key", "k.rest")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = materialize(keyed.join(sizes, "key"), "simhash-keys")
    out = _edges_of(sized.where(F.col("n") <= hot).select("key", "fp"))
    r = F.col("rest")
    again = [F.xxhash64("key", F.lit(t), _bits(r, 8 * a, 8), _bits(r, 8 * b, 8)) for t, (a, b) in enumerate(combinations(range(4), 2))]
    return out.union(_edges_of(sized.where(F.col("n") > hot).select(F.explode(F.array(*again)).alias("key"), "fp")))


def simhash_components(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, fp (long), fingerprint (16 hex digits), component_id, group_id; hashed: and text_hash.

    component_id is the least doc_id among all documents reachable; group_id names the group itself,
    also where no member has an id.
    """
    prints = materialize(fingerprints(docs, hashed), "simhash-fp", keep=True)
    with scratch(docs.sparkSession):
        distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
        roots = connected_components(links(distinct.select("fp")))
        member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = member.groupBy("root").agg(F.min("least").alias("component_id"))
        named = materialize(member.join(least, "root").select("fp", F.col("root").alias("group_id"), "component_id"), "simhash-groups", keep=True)
    return prints.join(named, "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_id", *(["text_hash"] if hashed else [])
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """docs with one document of each group: the one of least doc_id.

    Of several rows of the group with that doc_id, the one of least text stays; rows that share a doc_id in
    different groups are documents of their own. Rows without doc_id are never removed.
    """
    groups = simhash_components(docs.select("doc_id", "text"), hashed=True).where("doc_id = component_id")
    by_text = groups.groupBy("group_id", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    of_group = Window.partitionBy("group_id")
    lead = by_text.select(F.col("doc_id").alias("_lead"), F.col("text_hash").alias("_hash"), F.col("group_id").alias("_group"), F.sum("n").over(of_group).alias("_rows"))
    own = docs.where(F.col("doc_id").isNotNull())
    kept = own.join(lead, (own["doc_id"] == lead["_lead"]) & (F.xxhash64(own["text"]) == lead["_hash"]))
    # only groups whose least doc_id has several rows need a choice: other rows stay where the join puts them
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = kept.where("_rows > 1").groupBy("_group").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return kept.where("_rows = 1").select(*[own[f"`{c}`"] for c in docs.columns]).unionByName(chosen).unionByName(docs.where(F.col("doc_id").isNull()))
