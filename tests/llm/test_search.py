import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import ann


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(1))
        best = sorted((d[i], v) for i, v in enumerate(ids) if v != q)[:k]
        out[q] = [v for _, v in best]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_small_tables_are_exact(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[7]  # a vector that many rows share
    ids = list(range(0, 900, 3))
    clean = ann.clean_vectors(frame(spark, [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]))
    got = {}
    for r in ann.search(clean, clean.where("vec_id % 30 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    want = brute(ids, x.astype(float), [i for i in ids if i % 30 == 0])
    assert {q: [m[k] for k in sorted(m)] for q, m in got.items()} == want


@pytest.mark.parametrize("size", ["0.1"])
def test_recall_and_scores(spark, size):
    sf = f"/root/testdata/sf{size}"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = t["vec_id"].tolist(), np.stack(t["embedding"]).astype(float)
    queries = [i for i in ids if i % 100 == 0]
    want = brute(ids, x, queries)
    clean = ann.clean_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = ann.search(clean, clean.where("vec_id % 100 = 0")).collect()
    hit = sum(r.vec_id in want[r.query_id] for r in rows) / (10 * len(queries))
    assert hit >= 0.93
    for r in rows[:50]:
        assert r.score == pytest.approx(np.sqrt(((x[ids.index(r.query_id)] - x[ids.index(r.vec_id)]) ** 2).sum()), abs=1e-12)
    per = {}
    for r in rows:
        per.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert all([k for k, *_ in sorted(v)] == list(range(1, 11)) and sorted(v) == sorted(v, key=lambda z: (z[1], z[2])) for v in per.values())


def test_footrule():
    rnd = np.random.default_rng(3)
    x, piv = rnd.normal(size=(40, 5)), rnd.normal(size=(12, 5))
    index = ann.PermutationIndex(np.arange(40), x, piv, 6)
    q = ann.nearest_pivots(rnd.normal(size=(1, 5)), piv, 6)[0]
    perms = ann.nearest_pivots(index.unique, piv, 6)
    place = lambda p, k: list(p).index(k) if k in p else 6
    foot = [sum(abs(place(q, k) - place(p, k)) for k in set(q) | set(p)) for p in perms.tolist()]
    assert np.allclose(42 - 2 * index.saved(q), foot)


def test_bad_vectors_repeats_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, None), (400, [1.0, None]), (500, [nan, 1.0]), (600, [inf, 1.0]), (700, [1.0]), (None, [1.0, 1.0]), (3, [1.0, 0.5]), (4, [1.0, 0.5])]
    df = frame(spark, rows).withColumns({"score": F.lit(1), "v": F.lit(2)})
    clean = ann.clean_vectors(df)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(clean, clean.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(100, 1, 3), (100, 2, 4)]
    none = ann.clean_vectors(df.limit(0))
    assert ann.search(none, none).count() == 0


@pytest.mark.parametrize("blocks", [1, 8])
def test_recall_of_many_queries_in_blocks(spark, blocks):
    """A tenth of each block is measured; what is found doesn't hang on how the table lies."""
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(float)
    pivots = x[np.random.default_rng(1).permutation(len(x))[: ann.PIVOTS]]
    parts = [ann.PermutationIndex(ids[k::blocks], x[k::blocks], pivots, ann.PREFIX) for k in range(blocks)]
    queries = np.arange(0, len(x), 7)
    perms = ann.nearest_pivots(x[queries], pivots, ann.PREFIX)
    hit = 0
    for q, perm in zip(queries.tolist(), perms, strict=True):
        found = [p.search(int(ids[q]), x[q], perm, 10, ann.RERANK) for p in parts]
        got = np.concatenate([f[0] for f in found])[np.argsort(np.concatenate([f[1] for f in found]), kind="stable")[:10]]
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(got.tolist()) & set(ids[np.argsort(d)[:10]].tolist()))
    assert hit / (10 * len(queries)) >= 0.95
