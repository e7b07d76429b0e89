import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import quality_classifier as qc
from tallyforge.llm import quality_rules as qr
from tallyforge.llm import textstats as ts
from tallyforge.llm import toxicity as tox


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = [i for i, t in enumerate(tri) if tri.count(t) > 1]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len({j for i in again for j in (i, i + 1, i + 2)})]


TEXTS = [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\ny\nx\n\n x\n", "#*$ %&|<> é中🙂 z", "a b c d " * 40, "A\x0bB\x0cC\rD", "\n".join(["line one two", "line one two"])]


@pytest.mark.parametrize("text", TEXTS)
def test_base_statistics(text):
    assert ts.document_stats(text)[0] == brute_base(text)


def test_rules_query(spark, sf):
    from tallyforge.llm.queries import op3_quality_rules

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_quality_rules(spark, sf).collect():
        if len(docs[r.doc_id]) < 6000:
            base = brute_base(docs[r.doc_id])
            assert [r[c] for c in ts.BASE] == base
            assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert r.kept == (not r.base_failed and r.rule_score >= qr.KEEP_AT)


def test_forest_is_monotonic_and_flat_equals_walk():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(1500, 4))
    y = ((x[:, 0] + 0.8 * rnd.normal(size=1500) - (x[:, 1] > 0) * x[:, 2]) > 0).astype(float)
    f = qr.fit_forest(x, y, {0: 1, 3: -1}, trees=25)
    assert ((f.score(x) >= 0.5) == y).mean() > 0.75
    probe = rnd.normal(size=(60, 4))
    for j, s in ((0, 1), (3, -1)):
        grid = np.repeat(probe[:, None, :], 30, axis=1)
        grid[:, :, j] = np.linspace(-3, 3, 30)
        score = f.score(grid.reshape(-1, 4)).reshape(60, 30)
        assert (s * np.diff(score, axis=1) >= -1e-12).all()

    def walk(row):
        total = f.prior
        for n in f.roots:
            while f.left[n] >= 0:
                n = f.left[n] + (row[f.feature[n]] > f.threshold[n])
            total += f.value[n]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(probe), [walk(r) for r in probe])


def test_gam_learns_pairs_and_is_a_sum_of_tables():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(3000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rnd.random(3000) < 0.05)).astype(float)
    m = qc.fit_gam(x, y, rounds=20, pair_rounds=40, n_pairs=2)
    assert (0, 1) in m.pairs and ((m.score(x) >= 0.5) == y).mean() > 0.8
    r = x[5]
    by_hand = m.prior + sum(t[np.searchsorted(c, v, "left")] for t, c, v in zip(m.tables, m.cuts, r, strict=True))
    by_hand += sum(t[np.searchsorted(m.pair_cuts[a], r[a], "left"), np.searchsorted(m.pair_cuts[b], r[b], "left")] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
    assert m.logit(x[5:6])[0] == pytest.approx(by_hand)


@pytest.mark.parametrize("fit", [qr.fit_forest, qc.fit_gam])
def test_fits_without_labels(fit):
    x = np.zeros((0, len(ts.FEATURES)))
    assert 0 <= fit(x, np.zeros(0)).score(np.zeros((2, len(ts.FEATURES))))[0] <= 1
    one = fit(np.ones((3, len(ts.FEATURES))), np.ones(3))
    assert one.score(np.ones((1, len(ts.FEATURES))))[0] > 0.5


def check_fold(spark, sf, rows, label, modulus, remainder):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(rows) == docs
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return np.array(held)


def test_classifier_on_held_out_documents(spark):
    from tallyforge.llm.queries import op6_quality_classifier

    sf = "/root/testdata/sf0.01"
    held = check_fold(spark, sf, op6_quality_classifier(spark, sf).collect(), "quality", 3, 1)
    assert (held[:, 0] == held[:, 1]).mean() >= 0.95


def test_toxicity_on_held_out_documents(spark):
    from tallyforge.llm.queries import op9_toxicity

    sf = "/root/testdata/sf0.1"
    held = check_fold(spark, sf, op9_toxicity(spark, sf).collect(), "toxic", 5, 0)
    bad = held[:, 1] == 1
    assert (held[:, 0] == held[:, 1]).mean() >= 0.95 and held[bad, 0].mean() >= 0.7 and held[~bad, 0].mean() <= 0.015


def test_windows_cover_the_text():
    text = b"some words of a text " * 20 + b"x" * 200 + b" end"
    got = [w[len(tox.LEAD) :].strip(b" ") for w in tox.windows(text)]
    assert b"".join(got).replace(b" ", b"") == text.replace(b" ", b"") and max(map(len, got)) <= 2 * tox.WINDOW
    assert list(tox.windows(b"")) == []


def test_toxicity_fit_on_planted_terms():
    import random

    rnd = random.Random(0)
    word = lambda: "".join(rnd.choice(("ra", "lo", "mi", "te", "su", "no")) for _ in range(rnd.randint(1, 4)))
    docs = [([word() for _ in range(rnd.randint(20, 120))], int(i % 4 == 0)) for i in range(400)]
    for w, y in docs:
        for _ in range(3 * y):
            w.insert(rnd.randrange(len(w)), rnd.choice(("blastard", "frumpet", "grobnick")))
    texts, y = [" ".join(w) for w, _ in docs], np.array([y for _, y in docs])
    m = tox.fit(texts, y.tolist())
    s = tox.Savings(m)
    p = m.probability(np.array([s.of(t) for t in texts])) >= 0.5
    assert p[y == 1].mean() > 0.9 and p[y == 0].mean() < 0.05
    assert tox.fit(["a"], [0]).probability(np.zeros((1, tox.N_FEATURES)))[0] == 0


def odd(spark):
    rows = [(9, None), (2, ""), (None, "some text of words"), (1, "w " * 3000), (1, "w " * 3000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "kept": F.lit(1), "held_out": F.lit(2)})


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = odd(spark)
    for rows in (qr.apply_rules(df, qr.train(df, none)).collect(), qc.classify(df, qc.train(df, none)).collect(), tox.classify(df, tox.train(df, none)).collect()):
        assert len(rows) == 5
    assert not any(r.kept for r in qr.apply_rules(df, qr.train(df, none)).collect())  # too short, or one word again and again
    assert {r.held_out for r in qc.classify(df, qc.train(df, none)).where("doc_id is null").collect()} == {False}
    twice = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert qc.train(df, twice).prior < 0  # the least of several labels
    for f, m in ((qr.filter_docs, qr.train(df, none)), (qc.filter_docs, qc.train(df, none))):
        assert f(df, m).columns == df.columns and f(df.limit(0), m).count() == 0


def test_toxicity_fit_in_tasks_equals_the_fit_at_hand(spark):
    """Dictionaries byte by byte, weights up to the order of additions."""
    from tallyforge.llm.common import held_out, labelled_sample, table

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = sorted((r["doc_id"], r["y"], r["text"]) for v, n in ((1, tox.SAMPLE_TOXIC), (0, tox.SAMPLE_ORDINARY)) for r in labelled_sample(docs, labels, "toxic", ~held_out(tox.FOLD, tox.HELD), n, v).collect())
    a, b = tox.train(docs, labels), tox.fit([t for *_, t in rows], [int(y) for _, y, _ in rows])
    assert (a.ordinary, a.toxic) == (b.ordinary, b.toxic) and len(a.ordinary) > 1000
    assert np.allclose(a.weights, b.weights, atol=1e-6) and np.allclose(a.mean, b.mean)
