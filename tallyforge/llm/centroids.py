"""Centroid clustering in exact integers by delta Lloyd.

Vectors become integers floor(SCALE * x), so distances and sums are exact and the result doesn't depend on
how rows lie. What persists from round to round is a table of assignments (owner and squared distance beside the vector)
and, at the driver, count and componentwise sum of each of the k clusters. A round

* compares a vector with the centroids that changed in the last update, as all others are as far as they
  were; only where its own centroid moved is it compared with all (`reassign`);
* adds to the sums what moved vectors take from their old cluster and bring to their new one, signed integers
  aggregated in the tasks, so k x 64 sums of each task reach one small aggregation whatever the table's size.

No key is shuffled but the k cluster numbers, after tasks have summed: copies or a cluster of most vectors cost nothing more.

Defined cases: vectors that are null, of another length than `dim` or hold null or non-finite components are left out; ids
that repeat are rows of their own, those tied for a place among the first centroids ordered by their components; a null
id counts as an empty one for that choice; fewer vectors than k give as many centroids; vectors equal to several
centroids go to the smallest number, the others stay as they are; components of 2^21 or more, whose squares could pass
64 bits, are an error; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch

K, ROUNDS, SCALE, DIM, SEED = 16, 3, 64, 64, "1"
#: Integer components below this keep squared distances of up to 64 components in 64 bits.
LARGEST = 1 << 27
_STATE = "vec_id long, q array<int>, was int, owner int, distance long"


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the rows that take part, as integers."""
    v, inf = F.col("v"), float("inf")
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = d.where(F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False)))
    whole = lambda x: F.floor(x * scale)
    fits = lambda x: F.when(F.abs(x * scale) < LARGEST, whole(x)).otherwise(F.raise_error(F.lit("a component is too large to cluster")).cast("long"))
    return sound.select("vec_id", F.transform(v, lambda x: fits(x).cast("int")).alias("q"))


def first_centroids(kept: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """k vectors of least sha256 of "seed:vec_id"; a top-k, so tasks send k rows each at most."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of q from rows of c, exactly."""
    top = max(int(np.abs(q).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * q.shape[1] < 1 << 53:  # doubles hold every partial sum exactly
        qf, cf = q.astype(np.float64), c.astype(np.float64)
        return ((qf * qf).sum(1)[:, None] - 2 * (qf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    return np.stack([((q - x) ** 2).sum(1) for x in c], axis=1)


def reassign(q: np.ndarray, owner: np.ndarray, near: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) after the centroids flagged in `changed` moved. owner is -1 where none is known."""
    owner, near = owner.copy(), near.copy()
    moved = (owner < 0) | changed[owner]
    if moved.any():
        d = distances(q[moved], centroids)
        owner[moved] = d.argmin(1)  # the first of equals
        near[moved] = d.min(1)
    which = np.flatnonzero(changed)
    still = np.flatnonzero(~moved)
    if len(which) and len(still):
        d = distances(q[still], centroids[which])
        best = d.argmin(1)
        least, number = d[np.arange(len(still)), best], which[best]
        better = (least < near[still]) | ((least == near[still]) & (number < owner[still]))
        owner[still[better]] = number[better]
        near[still[better]] = least[better]
    return owner, near


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)


def _assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            old = b.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
            owner, near = reassign(_matrix(b.column("q"), b.num_rows), old, b.column("distance").to_numpy(zero_copy_only=False).astype(np.int64), centroids, changed)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(old, pa.int32()), pa.array(owner, pa.int32()), pa.array(near, pa.int64())], names=["vec_id", "q", "was", "owner", "distance"])

    return state.mapInArrow(run, _STATE)


def transfers(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(change of counts, change of sums) from vectors whose owner changed: tasks add up, k sums of each task are added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            q = _matrix(b.column("q"), b.num_rows) if b.num_rows else np.zeros((0, dim), np.int64)
            for column, sign in (("was", -1), ("owner", 1)):
                at = b.column(column).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in np.unique(at[at >= 0]):
                    mine = at == c
                    count[c] += sign * int(mine.sum())
                    total[c] += sign * q[mine].sum(0)
        some = np.flatnonzero((count != 0) | (total != 0).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["c", "n", "s"])

    moved = state.where("was <> owner").select("q", "was", "owner").mapInArrow(run, "c int, n long, s array<long>")
    sums = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    count, total = np.zeros(k, object), np.zeros((k, dim), object)
    for r in moved.groupBy("c").agg(F.sum("n").alias("n"), *sums).collect():  # k rows
        count[r["c"]] = int(r["n"])
        total[r["c"]] = [int(r[f"s{i}"]) for i in range(dim)]
    return count, total


def fit(kept: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """(assignments to the last centroids, centroids). Assignments: vec_id, q, was, owner, distance.

    Each round's table is written from the last one's, which can then go; python integers hold the global sums.
    """
    start = first_centroids(kept, k, seed)
    k = len(start)
    if not k:
        return kept.selectExpr("vec_id", "q", "-1 was", "-1 owner", "0L distance").limit(0), start
    centroids, changed = start, np.ones(k, bool)
    counts, sums = np.zeros(k, object), np.zeros((k, dim), object)
    state = kept.selectExpr("vec_id", "q", "-1 was", "-1 owner", "0L distance")
    with scratch(kept.sparkSession):
        for done in range(rounds + 1):
            state = materialize(_assigned(state, centroids, changed), "lloyd", keep=done == rounds)
            if done == rounds:
                break
            n, s = transfers(state, k, dim)
            counts, sums = counts + n, sums + s
            new = centroids.copy()
            for c in range(k):
                if counts[c] > 0:
                    new[c] = [x // counts[c] for x in sums[c]]
            changed, centroids = (new != centroids).any(1), new
    return state, centroids


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    state, centroids = fit(kept_vectors(vectors, id_col, vec_col, dim, scale), k, rounds, seed, dim)
    spark = vectors.sparkSession
    each = state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("i")).collect()  # k rows
    total = sum(int(r["i"]) for r in each)
    rows = [(r["owner"], int(r["i"]), total, hashlib.sha256(",".join(map(str, centroids[r["owner"]].tolist())).encode()).hexdigest()) for r in each]
    known = spark.createDataFrame(rows, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS) -> str:
    """The rows of cluster for DuckDB, every round a full comparison."""
    near = lambda r: f"""
a{r} AS (
  SELECT vec_id, argmin(c, d * {k} + c) AS c, min(d) AS d FROM (
    SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM comp v JOIN c{r} c USING (i) GROUP BY v.vec_id, c.c) GROUP BY vec_id
)"""  # noqa: E731
    move = lambda r: f"""
m{r} AS (
  SELECT a.c, v.i, CAST(floor_div(sum(v.x), count(*)) AS bigint) AS x FROM a{r} a JOIN comp v USING (vec_id) GROUP BY a.c, v.i
), c{r + 1} AS (
  SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (c, i)
)""".replace("floor_div(sum(v.x), count(*))", "(sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*)")  # noqa: E731
    steps = ",".join(near(r) + "," + move(r) for r in range(rounds)) + "," + near(rounds)
    return f"""
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
), comp AS (
  SELECT vec_id, i, CAST(floor({SCALE} * CAST(embedding[i] AS double)) AS bigint) AS x FROM kept, (SELECT unnest(range(1, {DIM} + 1)) AS i)
), seed AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS varchar))) - 1 AS c FROM kept
), c0 AS (
  SELECT s.c, v.i, v.x FROM seed s JOIN comp v USING (vec_id) WHERE s.c < {k}
),{steps},
named AS (
  SELECT c, sha256(string_agg(CAST(x AS varchar), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, CAST(c AS int) AS cluster, CAST(d AS bigint) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS bigint) AS cluster_inertia, CAST(sum(d) OVER () AS bigint) AS inertia, centroid_sha256
FROM a{rounds} JOIN named USING (c)
"""


ORACLE = oracle()
