import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import centroids as ce
from tallyforge.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=16, rounds=3, dim=64):
    """Lloyd in Python integers, every vector against every centroid each round."""
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]
    cents = [q for _, q in first]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for c in range(len(cents)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [near(q) for _, q in kept]
    inertia = {c: sum(d for d, o in last if o == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), sha[o]) for (i, _), (d, o) in zip(kept, last, strict=True)), key=str)


def found(df, **kw):
    return sorted(map(tuple, ce.cluster(df, **kw).collect()), key=str)


def vectors(n, seed=0, spread=1.0):
    rnd = np.random.default_rng(seed)
    return [(i, (spread * rnd.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("n,k,rounds,spread", [(150, 16, 3, 1.0), (150, 4, 6, 0.02), (60, 16, 0, 1.0), (9, 16, 3, 1.0), (40, 3, 2, 30_000.0)])
def test_equals_plain_lloyd(spark, n, k, rounds, spread):
    rows = vectors(n, n + k, spread)
    assert found(spark.createDataFrame(rows, SCHEMA), k=k, rounds=rounds) == plain(rows, k, rounds)


def test_defined_cases(spark):
    rows = vectors(60, 5)
    hot = rows[3][1]
    rows += [(100 + i, hot) for i in range(120)] + [(7, rows[7][1]), (7, hot), (None, hot), (None, rows[1][1])]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [float("nan")] * 64), (305, [float("inf")] + [0.0] * 63), (306, [None] + [0.0] * 63), (307, [0.0] * 64), (308, [-0.0] * 64)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({"owner": F.lit("clash"), "q": F.lit(1), "distance": F.lit(None)})
    assert found(df) == plain(rows + odd)


def test_all_equal_and_empty(spark):
    rows = [(i, [0.5] * 64) for i in range(40)]
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) and {r[1] for r in got} == {0}
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None)], SCHEMA)) == []


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark.createDataFrame([(1, [1e9] * 64)], SCHEMA))


def test_delta_compares_less(monkeypatch):
    """After an update of one centroid only its own vectors meet all centroids; the result is that of a full comparison."""
    rnd = np.random.default_rng(2)
    q, c = rnd.integers(-90, 90, (500, 64)), rnd.integers(-90, 90, (16, 64))
    c[9] = c[4]  # a tie that the smaller number wins
    none = np.full(500, -1)
    owner, near = ce.reassign(q, none, np.zeros(500, np.int64), c, np.ones(16, bool))
    changed = np.zeros(16, bool)
    changed[[2, 9]] = True
    c[2] += 3
    asked = []
    real = ce.distances
    monkeypatch.setattr(ce, "distances", lambda a, b: asked.append(len(a) * len(b)) or real(a, b))
    got = ce.reassign(q, owner, near, c, changed)
    mine = int(changed[owner].sum())
    assert sum(asked) == 16 * mine + 2 * (500 - mine) < 500 * 16
    monkeypatch.undo()
    want = ce.reassign(q, none, near, c, np.ones(16, bool))
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_wide_integers_are_exact():
    q = np.array([[(1 << 27) - 1] * 64, [-(1 << 27) + 1] * 64], np.int64)
    assert ce.distances(q, q).tolist() == [[0, 64 * (2 * ((1 << 27) - 1)) ** 2], [64 * (2 * ((1 << 27) - 1)) ** 2, 0]]


def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = QUERIES["op13_centroid_clustering"](spark, sf)
    cols = sorted(got.columns)
    want = db.sql(ORACLE_SQL["op13_centroid_clustering"])
    assert sorted(want.columns) == cols
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want.project(", ".join(cols)).fetchall(), key=str)
