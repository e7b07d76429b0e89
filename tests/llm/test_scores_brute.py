"""Scores of the trained queries against plain ones of each document, from the model's tables, nodes and dictionaries."""

import math
import re
from collections import Counter

import pytest
import zstandard

from tallyforge.llm import quality_classifier as qc
from tallyforge.llm import quality_rules as qr
from tallyforge.llm import queries as q
from tallyforge.llm import toxicity as tox
from tallyforge.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"


def plain_statistics(text):
    """Base statistics and features, in the order in which the models take them."""
    text = text or ""
    words, symbols = re.findall(WORD, text), sum(ch in "#*$%&|<>" for ch in text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeat = len({j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)})
    dup = sum(n - 1 for n in Counter(lines).values())
    n, chars = len(words), sum(map(len, words))
    base = [n, chars, symbols, dup, repeat]
    if not n:
        return base, [0.0] * 20
    count = Counter(words)
    size = lambda x: len(x.encode())
    letters = lambda w: w.strip(".,;:!?\"'()")
    return base, [
        math.log(n + 1), chars / n, symbols / chars, sum(w[0] in "#*$%&|<>" or w[-1] in "#*$%&|<>" for w in words) / n, dup / len(lines), repeat / n, len(count) / n**0.8, max(count.values()) / n,
        sum(ch.isupper() for ch in text) / chars, sum(ch.isdecimal() for ch in text) / chars, sum(ch in ".,;:?()\"'" for ch in text) / n, text.count("!") / n,
        sum(re.sub(r"[\x20\x09-\x0D]+\Z", "", x)[-1] in '.!?"' for x in lines) / len(lines), sum(size(w) > 20 for w in words) / n, sum(size(x) < 25 for x in lines) / len(lines), len(lines) / n,
        n / len(lines), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, text.count("|") / n, sum((letters(w).isascii() and letters(w).isalpha()) or ord(w[0]) > 127 for w in words) / n,
    ]


def sigmoid(z):
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def test_rules_by_node_walk(spark, sf):
    f = qr.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    texts = texts_of(spark, sf)
    rows = q.op3_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base, x = plain_statistics(texts[r.doc_id])
        total = f.prior
        for node in f.roots:
            while f.left[node] >= 0:
                node = f.left[node] + (x[f.feature[node]] > f.threshold[node])
            total += f.value[node]
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] == [*base, failed]
        assert r.rule_score == pytest.approx(sigmoid(total), abs=1e-9) and r.kept == (not failed and sigmoid(total) >= 0.5)


def test_classifier_by_sums_of_tables(spark, sf):
    m = qc.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    texts = texts_of(spark, sf)
    rows = q.op6_quality_classifier(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and m.pairs
    place = lambda cuts, v: sum(v > c for c in cuts)
    for r in rows:
        x = plain_statistics(texts[r.doc_id])[1]
        total = m.prior + sum(t[place(c, v)] for t, c, v in zip(m.tables, m.cuts, x, strict=True))
        for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
            total += t[place(m.pair_cuts[a], x[a])][place(m.pair_cuts[b], x[b])]
        assert r.score == pytest.approx(sigmoid(total), abs=1e-9) and r.predicted == (r.score >= 0.5)


def test_toxicity_by_single_windows(spark):
    sf = "/root/testdata/sf0.01"
    m = tox.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert m.toxic.startswith(m.ordinary) and len(m.toxic) > len(m.ordinary)

    def length(dictionary):
        p = zstandard.ZstdCompressionParameters.from_level(
            3, source_size=256, dict_size=len(dictionary), strategy=zstandard.STRATEGY_BTOPT, min_match=4, search_log=5, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
        return lambda w: len(c.compress(w))

    plain, toxic = length(m.ordinary), length(m.toxic)
    texts = texts_of(spark, sf)
    rows = {r.doc_id: r for r in q.op9_toxicity(spark, sf).collect()}
    assert set(rows) == set(texts)
    for i in sorted(texts)[::5]:  # a fifth of the fixture: each window is compressed twice here
        left, cut = " ".join((texts[i] or "").lower().split()).encode(), []
        while left:
            end = left.find(b" ", tox.WINDOW)
            end = min(len(left) if end < 0 else end, 2 * tox.WINDOW) if len(left) > tox.WINDOW else len(left)
            cut.append(left[:end])
            left = left[end:]
        saved = [plain(w) - toxic(w) for w in (tox.LEAD + b" " + c.strip(b" ") + b" " for c in cut)]
        top = sorted([s for s in saved if s > 0] + [0, 0, 0], reverse=True)[:3]
        x = [*top, *[math.log1p(sum(s >= k for s in saved)) for k in (6, 5, 4, 3, 2)], math.log1p(len(saved))]
        z = m.weights[0] + sum(w * (v - a) / b for w, v, a, b in zip(m.weights[1:], x, m.mean, m.scale, strict=True))
        assert rows[i].score == pytest.approx(sigmoid(z), abs=1e-9)
