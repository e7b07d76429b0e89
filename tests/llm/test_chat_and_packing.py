import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import chat_format as cf
from tallyforge.llm import packing as pk


def conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def brute_maximal(rows):
    by = {}
    for c, *turn in sorted(set(rows), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((turn[1] or "user", turn[2] or ""))
    whole = {}
    for c, t in by.items():
        whole.setdefault(tuple(t), []).append(c)
    return {min(ids, key=lambda i: (i is None, i)): (t, len(ids)) for t, ids in whole.items() if not any(len(o) > len(t) and o[: len(t)] == t for o in whole)}


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(60):
        n = rnd.randint(1, 5)
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", rnd.choice("ab")) for k in range(n)]
    want = brute_maximal(rows)
    got = {r.conv_id: r for r in cf.render(conv(spark, rows)).collect()}
    assert set(got) == set(want)
    for c, (turns, copies) in want.items():
        assert (got[c].n_turns, got[c].copies) == (len(turns), copies)
        assert got[c].text == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_ties_nulls_and_repeats_against_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, 0, 0, 1, 2]), rnd.choice([None, "user", "tool"]), rnd.choice([None, "a", "b"])) for _ in range(160)]
    rows += [(100 + c, *turn) for c in range(3) for turn in ((0, "user", "x"), (0, "user", "w" * 70000), (1, None, None))[: c + 1]] * 2
    want = brute_maximal(rows)
    got = {r.conv_id: r for r in cf.render(conv(spark, rows)).collect()}
    assert set(got) == set(want)
    for c, (turns, copies) in want.items():
        assert (got[c].n_turns, got[c].copies) == (len(turns), copies)
        assert got[c].text == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def test_defined_cases(spark):
    rows = [(1, 5, None, "a"), (1, 5, None, "a"), (1, 9, "assistant", None), (2, 0, "user", "a"), (3, 0, "user", "<|im_end|>x"), (None, 0, "user", "z"), (4, None, "system", "s"), (4, 0, "user", "q")]
    df = conv(spark, rows).withColumns({"n": F.lit(1), "copies": F.lit("clash")})
    got = {r.conv_id: r.text for r in cf.render(df).collect()}
    assert set(got) == {1, 3, None, 4}
    assert got[1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert got[3].count("<|im_end|>") == 1 and got[4].startswith("<|im_start|>system")
    assert cf.render(conv(spark, [])).count() == 0
    plan = cf.render(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_query_equals_sql(spark, sf):
    import duckdb

    from tallyforge.llm.queries import ORACLE_SQL, op4_chat_format

    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = {tuple(r) for r in db.sql("SELECT conv_id, n_turns, copies, text FROM (" + ORACLE_SQL["op4_chat_format"] + ")").fetchall()}
    assert {(r.conv_id, r.n_turns, r.copies, r.text) for r in op4_chat_format(spark, sf).collect()} == want


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_optimal(seed):
    rnd = np.random.default_rng(seed)
    cells = np.unique(rnd.integers(0, 60, 9))
    count = rnd.integers(1, 50, len(cells))
    cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(cells, count, strict=True))
    for k in (1, 2, 3, 20):
        top = max(1, int(cells[-1]))
        others = [max(1, int(c)) for c in cells[:-1]]
        best = min(cost([top, *pick]) for r in range(min(k, len(cells))) for pick in itertools.combinations(others, r))
        got = pk.best_bounds(cells, count, k)
        assert len(got) <= k and cost(got) == best


def test_word_count_and_cells(spark):
    texts = [None, "", " \n", "a", " a  b\tc\x0bd\x0ce\rf\n", "é 中  ", "x" * 50]
    want = [0, 0, 0, 1, 6, 3, 1]
    df = spark.createDataFrame([(t, w) for t, w in zip(texts, want, strict=True)], "text string, want long")
    assert df.where(pk.n_words(F.col("text")) != F.col("want")).count() == 0
    cells = spark.range(0, 200000, 7).select("id", pk.cell_of(F.col("id")).alias("c"))
    assert cells.where("c < id or (id < 512 and c <> id) or c > id * (1 + 1/256e0) + 1").count() == 0 and cells.select("c").distinct().count() < 3000


def check_packing(rows, docs, budget):
    assert len(rows) == docs
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.padded_to
        batches.setdefault((r.bucket, r.shard, r.batch), []).append(r)
    for b in batches.values():
        assert sorted(r.slot for r in b) == list(range(len(b))) and len({r.padded_to for r in b}) == 1
        assert len(b) == 1 or len(b) * b[0].padded_to <= budget
    parts = {}
    for (bucket, shard, batch), b in batches.items():
        parts.setdefault((bucket, shard), {})[batch] = len(b)
    for p in parts.values():
        assert sorted(p) == list(range(len(p))) and all(p[k] == p[0] for k in p if k < len(p) - 1)


def test_packing_query(spark, sf):
    from tallyforge.llm.queries import op10_packing

    docs = {r.doc_id: len((r.text or "").split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_packing(spark, sf).collect()
    check_packing(rows, len(docs), pk.TOKEN_BUDGET)
    cells = np.array(sorted({r.padded_to for r in rows}))
    assert len(cells) <= pk.BUCKETS


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "w " * 300), (5, "a b"), (5, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bucket": F.lit("x"), "n_tokens": F.lit(7)})
    got = pk.pack(df, buckets=2, budget=100, shard_rows=2).collect()
    check_packing(got, 6, 100)
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 2, 2, 300]
    assert pk.pack(df.limit(0)).count() == 0


def test_long_documents_are_padded_to_the_longest_of_their_bucket(spark):
    lengths = [3, 700, 701, 5003, 5003, 20001]
    df = spark.range(len(lengths)).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.get(F.array(*map(F.lit, lengths)), F.col("id").cast("int")).alias("n"))
    got = pk.pack(df, buckets=4, length=F.col("n")).collect()
    assert sorted((r.n_tokens, r.padded_to) for r in got) == [(3, 3), (700, 701), (701, 701), (5003, 5003), (5003, 5003), (20001, 20001)]


def test_bounds_of_the_query_against_the_best_of_all_lengths(spark):
    """Cells cost little: padding of the query's bounds over the table's exact lengths is within 0.1 % of the optimum's."""
    from tallyforge.llm.queries import op10_packing

    sf = "/root/testdata/sf0.1"
    rows = [(r.n_tokens, r.padded_to) for r in op10_packing(spark, sf).select("n_tokens", "padded_to").collect()]
    lengths, counts = np.unique(np.array([n for n, _ in rows]), return_counts=True)
    best = pk.best_bounds(lengths, counts, pk.BUCKETS)
    to = np.array(best)[np.searchsorted(best, np.maximum(lengths, 0))]
    optimum = int(((np.maximum(to, 1) - lengths) * counts).sum())
    assert optimum <= sum(p - n for n, p in rows) <= 1.001 * optimum
