"""Toxicity by compression distance: two zstandard dictionaries and calibrated window savings.

One raw-content dictionary holds what ordinary documents say, the other the same followed by what is
typical of toxic ones: terms whose byte 4- to 6-grams occur in a clearly greater share of toxic documents than of
equally long pieces of ordinary ones, the commonest last. A text is cut into windows of about `WINDOW` bytes at spaces; a window's saving
is how much shorter it compresses with the toxic dictionary. A logistic model of a document's strongest
savings, the number of windows by saving and the number of windows is calibrated out of fold: each third
of the labelled documents on dictionaries of the other two.

Labels come from at most `SAMPLE_TOXIC` + `SAMPLE_ORDINARY` labelled documents outside the held-out
fold (those of least id hash), whole; near copies among them count once. The bound on documents keeps
the fit the same for any corpus. Grams and words are counted and savings computed in tasks; the driver gets what
dictionaries are made of, and numbers. Scoring reads whole texts.

Defined cases: null and empty texts have no window and get the calibrated score for no saving; a null doc_id isn't held
out; repeated rows are scored each; without labels of both classes the score is 0 for all; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, materialize, scratch, with_text
from .textstats import chunks

SAMPLE_TOXIC, SAMPLE_ORDINARY = 3000, 6000
FOLD, HELD = 5, 0
WINDOW = 48
N_FEATURES = 9
GRAMS = (4, 5, 6)
#: Parts of the labelled documents; each is calibrated on what the others say.
THIRDS = 3
MIN_DOCS, MIN_RATIO = 6, 10.0
ORDINARY_TERMS, TOXIC_TERMS = 6000, 3000
#: Leads every window and both dictionaries, so that each frame has a match and pays its fixed cost.
LEAD = bytes(range(1, 9))
_TRIM = b".,;:!?\"'()#*$%&|"


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.toxic:
            return np.zeros(len(x))
        z = (x - self.mean) / self.scale @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cut(text: bytes, size: int):
    """Pieces of `size` bytes or up to twice as many, that end before a space if one comes in time."""
    at, n = 0, len(text)
    while at < n:
        to = at + size
        cut = text.find(b" ", to) if to < n else n
        cut = n if cut < 0 else min(cut, to + size)
        yield text[at:cut]
        at = cut


def windows(text: bytes, size: int = WINDOW):
    """Pieces of the text, each led and followed by a space."""
    for piece in _cut(text, size):
        yield LEAD + b" " + piece.strip(b" ") + b" "


def _compressor(dictionary: bytes):
    """Optimal parsing with matches of four bytes or more, without frame extras, so that only the content counts."""
    p = zstandard.ZstdCompressionParameters.from_level(
        3, source_size=256, dict_size=len(dictionary), strategy=zstandard.STRATEGY_BTOPT, min_match=4, search_log=5, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress


class Savings:
    """Features of a text: its three largest savings, how many windows save 2, 3, 4, 5 and 6 bytes or more (log), and how many there are (log)."""

    def __init__(self, model: Model):
        self.plain, self.toxic = _compressor(model.ordinary), _compressor(model.toxic)

    def of(self, text: str | None) -> list[float]:
        top, counts, n = [0, 0, 0], [0] * 8, 0
        plain, toxic = self.plain, self.toxic
        for w in windows(" ".join((text or "").lower().split()).encode()):
            n += 1
            s = len(plain(w)) - len(toxic(w))
            if s > top[2]:
                top = sorted((*top, s), reverse=True)[:3]
            counts[min(7, max(0, s))] += 1
        return [*map(float, top), *np.log1p(np.cumsum(counts[::-1])[1:6]).tolist(), float(np.log1p(n))]


def lowered(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def third(b: bytes) -> int:
    return zlib.crc32(b) % THIRDS


def signature(b: bytes) -> list[int]:
    """Least hashes of a document's long words."""
    return sorted({zlib.crc32(w) for w in set(b.split()) if len(w) >= 8})[:6]


def unlike(signatures: list[list[int]]) -> list[bool]:
    """Whether a document shares fewer than two of its signature's hashes with earlier ones that are kept; those of few long words do."""
    seen: set[int] = set()
    out = []
    for s in signatures:
        out.append(len(s) < 3 or sum(x in seen for x in s) < 2)
        if out[-1]:
            seen.update(s)
    return out


def gram_keys(b: bytes, size: int) -> np.ndarray:
    """Distinct byte grams of a text between spaces, as numbers."""
    a = np.frombuffer(b" " + b + b" ", np.uint8).astype(np.int64)
    k = np.zeros(max(0, len(a) - size + 1), np.int64)
    for i in range(size):
        k = (k << 8) | a[i : len(k) + i]
    return np.unique(k)


def count_grams(docs: Iterable[tuple[bytes, int]], size: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Grams of texts (with their third), all or among given ones, and by third in how many texts they stand."""
    keys, counts = (np.zeros(0, np.int64), np.zeros((0, THIRDS), np.int64)) if among is None else (among, np.zeros((len(among), THIRDS), np.int64))
    found, parts, held = [], [], 0

    def fold() -> None:
        nonlocal keys, counts, found, parts, held
        keys, at = np.unique(np.concatenate([keys, *found]), return_inverse=True)
        more = np.zeros((len(keys), THIRDS), np.int64)
        more[at[: len(counts)]] = counts
        np.add.at(more, (at[len(counts) :], np.concatenate([*parts, np.zeros(0, np.int64)])), 1)
        counts, found, parts, held = more, [], [], 0

    for b, p in docs:
        k = gram_keys(b, size)
        if among is not None:
            if len(among):
                at = np.minimum(np.searchsorted(among, k), len(among) - 1)
                counts[at[among[at] == k], p] += 1
            continue
        found.append(k), parts.append(np.full(len(k), p))
        held += len(k)
        if held > 2_000_000:  # folded in as they come, so that memory is that of distinct grams
            fold()
    if found:
        fold()
    return keys, counts


def count_words(docs: Iterable[tuple[bytes, int, int]]) -> dict[bytes, list[int]]:
    """Words of texts (toxic or not, third), trimmed: by class and third, in how many texts they stand; toxic ones first."""
    out: dict[bytes, list[int]] = {}
    for b, y, p in docs:
        at = p if y else THIRDS + p
        for w in {w.strip(_TRIM) for w in b.split()}:
            out.setdefault(w, [0] * (2 * THIRDS))[at] += 1
    return out


@dataclass
class Counts:
    """By third: toxic documents and ordinary pieces (2 x thirds); for each gram size, keys with toxic and ordinary counts; words."""

    texts: np.ndarray
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    words: dict[bytes, list[int]]


def dictionaries(counts: Counts, held: int | None) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries of all thirds but the one held out."""
    use = [p for p in range(THIRDS) if p != held]
    n_toxic, n_ordinary = counts.texts[:, use].sum(1).tolist()
    if not n_toxic or not n_ordinary:
        return b"", b""
    typical: set[bytes] = set()
    for size, (keys, t, o) in counts.grams.items():
        nt, no = t[:, use].sum(1), o[:, use].sum(1)
        good = (nt >= MIN_DOCS) & (nt / n_toxic / ((no + 1) / n_ordinary) >= MIN_RATIO)
        typical |= {int(k).to_bytes(size, "big") for k in keys[good]}
    least = max(3, round(0.006 * n_toxic))
    plain: list[tuple[int, bytes]] = []
    terms: list[tuple[int, bytes]] = []
    for w, c in counts.words.items():
        t, o = sum(c[p] for p in use), sum(c[THIRDS + p] for p in use)
        if o:
            plain.append((-o, w))
        p = b" " + w + b" "
        if t >= least and t / n_toxic >= MIN_RATIO * (o + 0.2) / n_ordinary and any(p[i : i + s] in typical for s in GRAMS for i in range(len(p) - s + 1)):
            terms.append((-t, w))
    rank = lambda found, k: b" ".join(w for _, w in reversed(sorted(found)[:k]))
    ordinary = LEAD + b" " + rank(plain, ORDINARY_TERMS) + b" "
    return ordinary, ordinary + rank(terms, TOXIC_TERMS) + b" "


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, l2: float = 1.0) -> np.ndarray:
    """Weights (bias first) by Newton's method."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [l2] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * np.maximum(p * (1 - p), 1e-9)) @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def piece_size(toxic: list[int]) -> int:
    """Ordinary documents are counted in pieces as long as toxic ones are on average: a gram's share of texts is compared at
    one length, or long documents would make every gram seem common."""
    return max(WINDOW, round(sum(toxic) / max(1, len(toxic))))


def calibrated(models: list[Model | None], x: np.ndarray, y: np.ndarray, again) -> Model:
    """The last model with weights fitted on savings x of documents by models that hadn't seen them; again() gives (x, y) by the last model itself."""
    if models[-1] is None:
        return Model()
    if len(set(y.tolist())) < 2:
        x, y = again()
    model = models[-1]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def _models(counts: Counts) -> list[Model | None]:
    """For each third, a model of the others; last, one of all."""
    return [Model(*d) if (d := dictionaries(counts, held))[1] else None for held in (*range(THIRDS), None)]


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Fit on labelled texts at hand: calibrated on savings by dictionaries of the other two thirds, then dictionaries of all."""
    b = [lowered(t) for t in texts]
    part = [third(x) for x in b]
    kept = np.zeros(len(b), bool)
    for v in (1, 0):
        mine = [i for i, y in enumerate(toxic) if y == v]
        kept[mine] = unlike([signature(b[i]) for i in mine])
    bad = [(x, p) for x, y, p, k in zip(b, toxic, part, kept, strict=True) if y and k]
    size = piece_size([len(x) for x, _ in bad])
    good = [(w, p) for x, y, p, k in zip(b, toxic, part, kept, strict=True) if not y and k for w in _cut(x, size)]
    of = lambda rows: np.bincount([p for _, p in rows], minlength=THIRDS)
    grams = {}
    for s in GRAMS:
        keys, t = count_grams(bad, s)
        some = t.sum(1) >= MIN_DOCS
        grams[s] = (keys[some], t[some], count_grams(good, s, keys[some])[1])
    models = _models(Counts(np.stack([of(bad), of(good)]), grams, count_words([(w, 1, p) for w, p in bad] + [(w, 0, p) for w, p in good])))
    savings = [m and Savings(m) for m in models]
    own = [(savings[p].of(t), y) for t, y, p in zip(texts, toxic, part, strict=True) if savings[p]]
    matrix = lambda rows: (np.array([r[0] for r in rows], float).reshape(-1, N_FEATURES), np.array([r[1] for r in rows], float))
    return calibrated(models, *matrix(own), lambda: matrix([(savings[-1].of(t), y) for t, y in zip(texts, toxic, strict=True)]))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = SAMPLE_TOXIC, ordinary_rows: int = SAMPLE_ORDINARY) -> Model:
    """As fit, where the sample lies: tasks count and score, the driver gets signatures, grams and words that can matter, and savings."""
    with scratch(docs.sparkSession):
        both = [labelled_sample(docs, labels, "toxic", ~held_out(FOLD, HELD), n, v) for v, n in ((1, toxic_rows), (0, ordinary_rows))]
        sample = both[0].union(both[1]).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("y").cast("int").alias("y"))
        sample = with_text(materialize(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id"), "toxic-sample"))

        def signatures(batches):
            for b in chunks(batches):
                t = [lowered(x) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([signature(x) for x in t], pa.list_(pa.int64())), pa.array(list(map(len, t)), pa.int64())], names=["doc_id", "y", "s", "n"])

        known = sorted(tuple(r) for r in sample.mapInArrow(signatures, "doc_id long, y int, s array<long>, n long").collect())
        kept: set[int] = set()
        for v in (1, 0):
            mine = [r for r in known if r[1] == v]
            kept |= {r[0] for r, k in zip(mine, unlike([r[2] for r in mine]), strict=True) if k}
        return _train_on(sample, kept, piece_size([r[3] for r in known if r[1] == 1 and r[0] in kept]))


def _train_on(sample: DataFrame, kept: set[int], size: int) -> Model:
    def texts(batches, toxic: int):
        for b in chunks(batches):
            for i, t, y in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("y").to_pylist(), strict=True):
                if y == toxic and i in kept:
                    x = lowered(t.as_py())
                    for piece in ([x] if toxic else _cut(x, size)):
                        yield piece, third(x)

    # several passes of small memory over a bounded sample
    named = [f"c{p}" for p in range(THIRDS)]
    shape = "k long, " + ", ".join(f"{c} long" for c in named)

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(pa.array(c, pa.int64()) for c in counts.T)], names=["k", *named])

    def summed(run) -> tuple[np.ndarray, np.ndarray]:
        found = sample.mapInArrow(run, shape).groupBy("k").agg(*[F.sum(c).alias(c) for c in named])
        if run.__name__ == "of_toxic":
            found = found.where(sum(F.col(c) for c in named) >= MIN_DOCS)
        t = found.toPandas().sort_values("k")
        return t["k"].to_numpy(np.int64), t[named].to_numpy(np.int64).reshape(-1, THIRDS)

    grams = {}
    for s in GRAMS:

        def of_toxic(batches, s=s):
            yield rows(*count_grams(texts(batches, 1), s))

        keys, t = summed(of_toxic)

        def of_ordinary(batches, s=s, keys=keys):
            n = count_grams(texts(batches, 0), s, keys)[1]
            some = n.any(1)
            yield rows(keys[some], n[some])

        at, n = summed(of_ordinary)
        o = np.zeros_like(t)
        o[np.searchsorted(keys, at)] = n
        grams[s] = (keys, t, o)

    def numbers(batches):
        batches = list(batches)
        for y in (1, 0):
            n = np.bincount([p for _, p in texts(batches, y)], minlength=THIRDS)
            yield rows(np.array([y]), n.reshape(1, -1))

    at, n = summed(numbers)
    total = np.zeros((2, THIRDS), np.int64)
    total[1 - at] = n
    columns = [*(f"t{p}" for p in range(THIRDS)), *(f"o{p}" for p in range(THIRDS))]

    def words(batches):
        batches = list(batches)
        found = count_words((x, y, p) for y in (1, 0) for x, p in texts(batches, y))
        n = np.array(list(found.values()), np.int64).reshape(-1, 2 * THIRDS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *(pa.array(c) for c in n.T)], names=["w", *columns])

    every = materialize(sample.mapInArrow(words, "w binary, " + ", ".join(f"{c} long" for c in columns)).groupBy("w").agg(*[F.sum(c).alias(c) for c in columns]), "toxic-words")
    frequent = lambda held: every.orderBy(F.desc(sum(F.col(f"o{p}") for p in range(THIRDS) if p != held)), "w").limit(ORDINARY_TERMS)
    wanted = every.where(sum(F.col(f"t{p}") for p in range(THIRDS)) >= 3)
    for held in (*range(THIRDS), None):
        wanted = wanted.union(frequent(held))
    models = _models(Counts(total, grams, {bytes(r[0]): list(r[1:]) for r in wanted.distinct().collect()}))
    features = [f"f{i}" for i in range(N_FEATURES)]

    def savings(which):
        def run(batches):
            of = [m and Savings(m) for m in models]
            for b in chunks(batches):
                got = []
                for i, t, y in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("y").to_pylist(), strict=True):
                    t = t.as_py()
                    own = of[third(lowered(t)) if which is None else which]
                    if own:
                        got.append((i, y, *own.of(t)))
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64() if j == 0 else pa.float64()) for j in range(2 + N_FEATURES)], names=["doc_id", "y", *features])

        t = sample.mapInArrow(run, "doc_id long, y double, " + ", ".join(f"{f} double" for f in features)).toPandas().sort_values(["doc_id", "y", *features])
        return t[features].to_numpy(float).reshape(-1, N_FEATURES), t["y"].to_numpy(float)

    return calibrated(models, *savings(None), lambda: savings(THIRDS))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        savings = Savings(model) if model.toxic else None
        for b in chunks(batches):
            x = np.array([savings.of(t) if savings else [0.0] * N_FEATURES for t in b.column("text").to_pylist()]).reshape(-1, N_FEATURES)
            score = model.probability(x)
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLD, HELD).alias("held_out"), "text")
    return with_text(src).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
