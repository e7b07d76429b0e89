import os
import random

import pytest

from tallyforge.llm import sentencepiece_codec as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no model file")


@pytest.fixture(scope="module")
def enc():
    return sp.Encoder(sp._read(sp.MODEL))


def by_chunks(enc, text, chunk):
    parts = sp.split_giant(enc.pieces, sp.normalized(text), chunk)
    states = sp.resolve([sp.chunk_matrix(enc, *p) for p in parts])
    return sum((sp.chunk_ids(enc, p[1], p[2], states[i], states[i + 1]) for i, p in enumerate(parts)), [])


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "中文字é🙂ß ", "a ", "     x", "\n\tab "])
def test_bpe_scan_equals_the_library(enc, alphabet):
    rnd = random.Random(alphabet)
    for _ in range(12):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 300)))
        assert by_chunks(enc, text, rnd.choice([17, 40])) == enc.sp.encode(text)


class Toy:
    def __init__(self, scores):
        self.pieces = sp.Pieces.of({p: i + 1 for i, p in enumerate(scores)}, scores, sp._UNIGRAM)
        self.transfer = lambda *a: sp.unigram_transfer(self, *a)


def viterbi(pieces, text):
    best, back = sp.unigram_best(pieces, text, 0, len(text))
    return best[len(text)]


@pytest.mark.parametrize("seed", range(5))
def test_unigram_scan_equals_one_pass(seed):
    rnd = random.Random(seed)
    scores = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 5))): -rnd.random() * 5 for _ in range(25)}
    toy = Toy(scores)
    text = "".join(rnd.choice("abcd") for _ in range(160))
    parts = sp.split_giant(toy.pieces, text, 23)
    ms = [sp.chunk_matrix(toy, *p) for p in parts]
    states = sp.resolve(ms)
    assert sum(ms[i][states[i], states[i + 1]] for i in range(len(ms))) == pytest.approx(viterbi(toy.pieces, text))
    ids = sum((sp.chunk_ids(toy, p[1], p[2], states[i], states[i + 1]) for i, p in enumerate(parts)), [])
    name = {i: p for p, i in toy.pieces.ids.items()}
    spelled = sum((scores[name[i]] if i else toy.pieces.unknown_score) for i in ids)
    assert spelled == pytest.approx(viterbi(toy.pieces, text))


def test_product_is_associative():
    rnd = random.Random(1)
    m = [{((0, i), (0, j)): rnd.random() for i in range(3) for j in range(3) if rnd.random() < 0.8} for _ in range(3)]
    a, b = sp.product(sp.product(m[0], m[1]), m[2]), sp.product(m[0], sp.product(m[1], m[2]))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_documents_round_trip(spark, sf, enc):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sp.decode(sp.encode(docs, giant=2000, chunk=500)).collect()
    texts = [r.text for r in got]
    assert [r.ids for r in got] == enc.sp.encode(texts) and [r.decoded for r in got] == texts


def test_edges(spark):
    long = "x" * 5000
    rows = [(1, None), (2, ""), (None, "a  b"), (4, long), (4, long), (5, "▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' ids", "1 decoded", "2 key")
    got = sp.decode(sp.encode(df, giant=1000, chunk=300)).collect()
    assert len(got) == 6 and all(r.ids == [] for r in got if not r.text)
    assert all(r.decoded == (r.text or "") for r in got if r.text != "▁")
    assert sp.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_other_models_are_refused():
    spec = b"\x1a\x02\x20\x01"  # remove_extra_whitespaces
    with pytest.raises(ValueError):
        sp.Pieces.load(spec)
