import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import fill_in_middle as fim
from tallyforge.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string"


def plain(doc_id, text):
    """The row of one document, straight from tokens."""
    text = text or ""
    tok = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(tok) + 1), h2 % (len(tok) + 1)))
    p, m, s = "".join(tok[:a]), "".join(tok[a:b]), "".join(tok[b:])
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    changed = form != "plain"
    return doc_id, len(tok), form, len(p) if changed else None, len(m) if changed else None, out


def texts(n, seed=3):
    rnd = random.Random(seed)
    make = lambda: "".join(rnd.choice(["word", "x", " ", "\n", "é", "7", "<", "S>", "𝄞", "Zed"]) for _ in range(rnd.randint(0, 60)))
    return [(i, make()) for i in range(n)]


CASES = [(None, "no id here"), (None, None), (900, None), (901, ""), (902, "one"), (903, "a<P>b"), (904, "same row"), (904, "same row"), (905, "ÿ𝄞\x00"), (906, "x" * 5000), (907, " " * 5000), (908, "long text, " * 9000)]


@pytest.mark.parametrize("chunk,giant", [(fim.CHUNK, fim.GIANT), (7, 3), (1, 1), (16, 10_000)])
def test_equals_tokens(spark, chunk, giant):
    rows = texts(120) + CASES
    if chunk == 1:
        rows = [r for r in rows if len(r[1] or "") < 400]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("clash"), "form": F.lit(1), "_c": F.lit(2), "k": F.lit(3), "output": F.lit("x")})
    got = fim.transform(df, chunk=chunk, giant=giant).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((plain(*r) for r in rows), key=key)


def test_outputs_restore(spark):
    rows = texts(200, 5) + CASES
    out = fim.transform(spark.createDataFrame(rows, SCHEMA)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert sorted(str(r.back) for r in out.collect()) == sorted(t or "" for _, t in rows)
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_chunks_count_alone():
    text = "abc def9Gh" * 50
    for chunk in (1, 2, 3, 10, 499, 500, 501):
        counts = [int(fim.starts(p, o).sum()) for o, p in fim.pieces(text, chunk)]
        assert sum(counts) == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))


def test_only_owners_are_looked_through(monkeypatch):
    seen = []
    real = fim.starts
    monkeypatch.setattr(fim, "starts", lambda p, o: seen.append(len(p)) or real(p, o))
    text = "ab " * 10_000
    fim.cut_places(text, 5, 9_000, 1_000)
    assert len(seen) == 30 + 2


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = QUERIES["op12_fill_in_middle"](spark, sf)
    cols = sorted(got.columns)
    want = db.sql(ORACLE_SQL["op12_fill_in_middle"])
    assert sorted(want.columns) == cols
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want.project(", ".join(cols)).fetchall(), key=str)
