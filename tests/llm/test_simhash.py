import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import simhash as sh
from tallyforge.llm.common import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "One two", "a b c", "A  b c d\x1ce É ß", "x " * 500, "中文 字 🙂 é " * 9, "a\x0bb\x0cc\rd e f g"])
def test_fingerprint(text):
    assert sh.fingerprint(None if text is None else text.encode()) == brute_print(text)


def test_known_hash_is_engine_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_close_pairs(radius):
    rnd = np.random.default_rng(radius)
    base = rnd.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = np.array([b ^ np.uint64(sum(1 << int(k) for k in rnd.choice(64, rnd.integers(0, 5), replace=False))) for b in base for _ in range(20)])
    group = np.sort(rnd.integers(0, 3, len(fp)))
    got = {tuple(sorted(p)) for i, j in sh.close_pairs(fp, group, radius, block=300) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and bin(int(fp[i] ^ fp[j])).count("1") <= radius}
    assert got == want and want


def brute_components(items):
    """items: (doc_id, fp) -> {doc_id: least reachable}"""
    left = dict(items)
    out = {}
    while left:
        todo, seen = [next(iter(left))], set()
        while todo:
            d = todo.pop()
            if d in seen:
                continue
            seen.add(d)
            todo += [e for e in left if e not in seen and bin(left[d] ^ left[e]).count("1") <= 2]
        for d in seen:
            out[d] = min(seen)
            del left[d]
    return out


@pytest.mark.parametrize("hot", [1, 4096])
def test_links_reach_what_all_pairs_reach(spark, hot):
    rnd = random.Random(hot)
    base = [rnd.getrandbits(64) for _ in range(15)]
    fps = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 4))) for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = sh.links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot)
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    ids = {s: roots.get(s, s) for s in signed}
    want = brute_components(list(enumerate(fps)))
    groups = {}
    for i, s in enumerate(signed):
        groups.setdefault(ids[s], set()).add(i)
    wanted = {}
    for i, w in want.items():
        wanted.setdefault(w, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_query_against_brute_force(spark, sf):
    from tallyforge.llm.queries import op1_simhash_near_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: brute_print(r.text) for r in docs}
    comp = brute_components(list(want.items()))
    got = op1_simhash_near_dedup(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", comp[d]) for d, f in want.items()}


def test_nulls_copies_ties_and_clashing_columns(spark):
    rows = [(3, None, "k"), (2, "", "k"), (None, "a b c d", None), (None, "a b c d", "k"), (7, "x y z", "k"), (7, "x y z", "k"), (5, "X y  z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumns({"component_id": F.lit("z"), "key": F.lit(1)})
    got = sorted(((r.doc_id, r.component_id) for r in sh.simhash_components(df).collect()), key=str)
    assert got == sorted([(3, 2), (2, 2), (None, None), (None, None), (7, 5), (7, 5), (5, 5)], key=str)
    kept = sh.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, None, None, 5], key=str)


def test_rows_of_one_id_in_different_groups_each_stay(spark):
    near, far, lone = "one two three four five", "w x y z and more words", "nothing like the others here at all"
    rows = [(1, near), (1, far), (1, near.upper()), (2, near), (2, lone), (3, far), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text or "") for r in sh.near_dedup(df).collect()))
    assert got == [(1, near.upper()), (1, far), (2, lone), (3, "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sh.simhash_components(df).count() == 0 and sh.near_dedup(df).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id u", "id + 1 v")
    assert connected_components(edges).select("root").distinct().count() == 1
    two = edges.where("u <> 150")
    assert connected_components(two).groupBy("root").count().count() == 2
