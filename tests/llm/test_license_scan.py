import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import license_scan as ls
from tallyforge.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(rows, rare=ls.RARE, agree=ls.AGREE, drift=ls.DRIFT, cover=ls.COVER):
    """Every template tried at every start of every text, word by word."""
    docs = [(i, words_of(t)) for i, t in rows]
    known = {w for _, p, _ in ls.TEMPLATES for w in p.split()} | {w for p in ls.BASE for w in p.split()}
    idf = {w: math.log((len(docs) + 2) / (sum(w in set(d) for _, d in docs) + 1)) for w in known}
    order = {w: i for i, w in enumerate(sorted(w.encode() for w in known))}
    out = []
    for i, d in docs:
        base = [(p, label) for phrase, label in ls.BASE.items() for p in range(len(d)) if d[p : p + len(phrase.split())] == phrase.split()]
        labels, score = {x[1] for x in base}, ls.BASE_SCORE if base else 0.0
        for label, passage, keys in ls.TEMPLATES:
            t = passage.split()
            posted = sorted(set(t), key=lambda w: (-idf[w], order[w.encode()]))[:rare]
            near = lambda w, s: w in d[max(0, s) : max(0, s + drift + 1)]  # noqa: B023, E731
            for s in range(-len(t), len(d)):
                # a start is one that a posted word votes for
                if not any(w in posted and 0 <= s + j < len(d) and d[s + j] == w for j, w in enumerate(t)):
                    continue
                if sum(any(near(w, s + j) for j in range(len(t)) if t[j] == w) for w in posted) < math.ceil(agree * len(posted)):
                    continue
                held = True
                for k in keys:
                    k = k.split()
                    at = next(j for j in range(len(t)) if t[j : j + len(k)] == k)
                    held &= any(d[p : p + len(k)] == k for p in range(max(0, s + at), max(0, s + at + drift + 1)))
                share = sum(idf[w] for j, w in enumerate(t) if near(w, s + j)) / sum(idf[w] for w in t)
                if held and share >= cover:
                    labels, score = labels | {label}, max(score, min(share, 1.0))
        places = [p for p, _ in base]
        out.append((i, len(d), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x[1] for x in base})), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted(((*r[:-1], round(r[-1], 9)) for r in map(tuple, ls.scan(df, **kw).select(*COLUMNS).collect())), key=str)


CASES = [
    (0, None), (1, ""), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under the Apache License, Version 2.0."),
    (5, "This work is licensed under the GNU General Public License, version 3."), (None, "an MIT-license"), (6, "MIT licenses are not it, nor is emit license"), (7, "MİT LICENSE mit\u00a0license"),
    (8, "mit license mit license\nMIT, License"), (9, ls.TEMPLATES[1][1].upper()), (10, "All kinds of things. " * 30 + ls.TEMPLATES[9][1] + " except some " + ls.TEMPLATES[10][1]),
    (11, ls.TEMPLATES[11][1].replace("notice appear", "notice must well appear")), (12, "the software is granted free of any charge to a person " * 20), (13, "licensed by cc nc under 4 0"), (14, "apache 2 0 license version"), (15, "GNU Lesser General Public License under the terms of the"),
]


def edited(n, seed=1):
    """Templates with words left out, put in and swapped, between other words."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w = rnd.choice(ls.TEMPLATES)[1].split() + rnd.choice(ls.TEMPLATES)[1].split()
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice([[], [w[at], "extra"], ["other"], [w[at], w[at]]])
        out.append((100 + i, " ".join([*rnd.choices(["the", "of", "license", "word", "2"], k=rnd.randint(0, 9)), *w, "end"])))
    return out


@pytest.mark.parametrize("options", [{}, {"rare": 3, "agree": 1.0, "drift": 0}, {"rare": 63, "agree": 0.3, "drift": 12, "cover": 0.5}])
def test_equals_every_start_tried(spark, options):
    rows = CASES + edited(60)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"labels": F.lit(1), "found": F.lit("clash"), "n": F.lit(None)})
    assert found(df, **options) == plain(rows, **options)


def test_labels(spark):
    rows = [(i, t) for i, t in CASES if i is not None] + [(50 + i, f"Kopf.\n{t[1]}\nEnde.") for i, t in enumerate(ls.TEMPLATES)] + [(200 + i, f"nothing of the kind, document {i} of many") for i in range(200)]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].labels == "mit" and got[2].score == 1.0 and got[3].labels == "cc-by-nc-4.0" and got[4].labels == "apache,apache-2.0" and got[5].labels == "gpl,gpl-3.0"
    assert got[6].labels == got[7].labels == got[12].labels == got[13].labels == got[14].labels == "" and got[11].labels == "isc" and "bsd,bsd-3-clause" == got[10].labels
    for i, (label, _, _) in enumerate(ls.TEMPLATES):
        assert label in got[50 + i].labels.split(","), ls.TEMPLATES[i]
    assert all(got[200 + i].score == 0 and got[200 + i].labels == "" for i in range(200))


def test_long_text_is_cut_in_pieces(monkeypatch):
    vocab = ls.vocabulary(ls.read_templates(), ls.BASE)
    text = "Wörter der MIT License, und so weiter; " * 300
    whole = ls.hits(text, vocab)
    for size in (1, 7, 100):
        monkeypatch.setattr(ls, "PIECE", size)
        got = ls.hits(text, vocab)
        assert got[0] == whole[0] == len(words_of(text)) and all((a == b).all() for a, b in zip(got[1:], whole[1:], strict=True))


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_every_document(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r) for r in QUERIES["op11_license_scan"](spark, sf).select(*COLUMNS).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        d = words_of(t)
        places = [(p, label) for phrase, label in ls.BASE.items() for p in range(len(d)) if d[p : p + len(phrase.split())] == phrase.split()]
        assert got[i][1:5] == (len(d), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None))
        assert got[i][5] == ",".join(sorted({x for _, x in places})) and set(got[i][5].split(",")) - {""} <= set(got[i][6].split(","))
        assert ("cc-by-nc-4.0" in got[i][6].split(",")) == ("CC BY-NC 4.0" in (t or ""))
    assert any(r[6] for r in got.values()) and np.isfinite([r[7] for r in got.values()]).all()
