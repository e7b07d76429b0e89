import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import line_dedup as ld


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def variants(seed):
    rnd = random.Random(seed)
    out = set()
    for _ in range(14):
        s = [rnd.choice("abcé ") for _ in range(rnd.randint(6, 26))]
        for _ in range(7):
            t = list(s)
            for _ in range(rnd.randint(0, 3)):
                k = rnd.randrange(len(t))
                rnd.choice([lambda: t.insert(k, "b"), lambda: t.pop(k), lambda: t.__setitem__(k, "c")])()
            out.add("".join(t).strip())
    return sorted(x for x in out if len(x) >= 4)


@pytest.mark.parametrize("edits,hot", [(1, 64), (1, 1), (2, 64), (2, 2)])
def test_links_are_all_pairs_within_the_edits(spark, edits, hot):
    lines = variants(edits)
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line"))
    name = {r.h: r.line for r in df.collect()}
    got = {tuple(sorted((name[r.u], name[r.v]))) for r in ld.line_links(df, edits, hot).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(lines, 2) if distance(a, b) <= edits}


def test_live_lines_with_keys_sent_and_shuffled(spark):
    df = spark.createDataFrame([(x,) for x in variants(2) * 2], "line string").withColumns(ld._identity("line"))
    sent, dealt = (sorted((r.line, r.n, sorted(map(tuple, r.posts))) for r in ld.live_lines(df, 2, n).collect()) for n in (ld.SENT, 0))
    assert sent == dealt and len(sent) > 20


def brute(docs, edits=2, min_chars=8, near_chars=32):
    """docs: (id, text), ids unique. Kept texts by id."""
    at = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            s = line.strip(" ")
            if len(s) >= min_chars:
                at.setdefault(s, []).append(i)
    names = list(at)
    group = {s: s for s in names}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    for a, b in itertools.combinations(names, 2):
        if min(len(a), len(b)) >= near_chars and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
            group[root(a)] = root(b)
    owner = {}
    for s, ids in at.items():
        owner[root(s)] = min([owner.get(root(s), 1 << 62), *ids])
    out = {}
    for i, text in docs:
        if text is None:
            out[i] = None
            continue
        seen, kept = set(), []
        for line in text.split("\n"):
            s = line.strip(" ")
            if len(s) < min_chars:
                kept.append(line)
            elif owner[root(s)] == i and root(s) not in seen:
                kept.append(line)
                seen.add(root(s))
        out[i] = "\n".join(kept)
    return out


LONG = "this is quite a long line of text, number one"
DOCS = [(1, f"{LONG}\nshort\n\n  {LONG}  \nunique of one"), (2, f"{LONG}!\nshort\nsomething else entirely"), (3, "something else entirely"), (4, ""), (5, None), (6, "\n\n"), (7, f"{LONG[1:]}\n{LONG[:-1]}x y")]


def test_small_documents(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("class", F.lit("clash")).withColumn("keep", F.lit(1))
    got = {r.doc_id: r.text for r in ld.line_dedup(df).collect()}
    assert got == brute(DOCS)
    assert got[3] == "" and got[5] is None and got[1].count(LONG) == 1
    assert ld.line_dedup(df).columns == ["doc_id", "text", "class", "keep", "lines_in", "lines_out"]


def test_query_against_brute_force(spark, sf):
    from tallyforge.llm.queries import op8_line_dedup

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_line_dedup(spark, sf).collect()
    assert {r.doc_id: r.text for r in got} == brute(docs)
    assert all(r.lines_out <= r.lines_in for r in got)


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "a line without owner"), (None, "a line without owner"), (4, "line of four again"), (4, "line of four again"), (9, "line of four again")]
    got = sorted(((r.doc_id, r.text) for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, "a line without owner")] * 2 + [(4, "line of four again")] * 2 + [(9, "")], key=str)
    assert ld.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_native(spark):
    df = ld.line_dedup(spark.createDataFrame(DOCS, "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_query_and_stage_link_lines_two_edits_apart(spark, tmp_path):
    import corpus_pipeline
    from tallyforge.llm.queries import QUERIES

    docs = [*DOCS, (8, LONG.replace("quite", "quote").replace("text", "test")), (9, LONG[2:]), (10, LONG.replace("quite", "quXYZ"))]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(docs)
    assert want[8] == "" == want[9] and want[10] and brute(docs, edits=1)[8]
    assert {r.doc_id: r.text for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, df, "").collect()} == want
