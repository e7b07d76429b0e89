"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in cycles: each step fits one depth-limited tree on a single feature's
bins and adds it to that feature's look-up table, so the model stays a sum of tables. The strongest pairs
are then chosen by what a 2-d table gains on the residuals, and boosted in the same cyclic way. Scoring
adds bins: score = sigmoid(prior + sum table[bin] + sum pair_table[bin, bin]).

Labels come from at most `sample_rows` labelled documents outside the held-out fold (those of least id
hash), whatever the corpus; label, language, source and id are never inputs.

Defined cases: null and empty texts are scored as texts without words; a null doc_id is not held out;
repeated rows are scored each; without labels the score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, with_text
from .textstats import FEATURES, chunks, stats_of, training_matrix

SAMPLE_ROWS = 12000
FOLD, HELD = 3, 1


@dataclass
class Gam:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += t[np.searchsorted(c, x[:, j], "left")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.pair_cuts)]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, m: int, leaves: int, l2: float) -> np.ndarray:
    """Values by bin of a tree with few leaves on one ordered feature."""
    gb, hb = np.bincount(bins, g, m), np.bincount(bins, h, m)
    cg, ch = np.concatenate(([0], gb.cumsum())), np.concatenate(([0], hb.cumsum()))
    parts = [(0, m)]
    while len(parts) < leaves:
        best = (1e-7, None)
        for q, (a, z) in enumerate(parts):
            if z - a < 2:
                continue
            k = np.arange(a + 1, z)
            gl, hl, gt, ht = cg[k] - cg[a], ch[k] - ch[a], cg[z] - cg[a], ch[z] - ch[a]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            if gain.max() > best[0]:
                best = (float(gain.max()), (q, int(k[gain.argmax()])))
        if best[1] is None:
            break
        q, k = best[1]
        a, z = parts.pop(q)
        parts += [(a, k), (k, z)]
    out = np.zeros(m)
    for a, z in parts:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + l2)
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, bins: int = 64, pair_bins: int = 8, leaves: int = 3, rate: float = 0.1, l2: float = 3.0) -> Gam:
    n, d = len(y), len(FEATURES) if x.size == 0 else x.shape[1]
    if n == 0 or y.min() == y.max():
        prior = 0.0 if n == 0 else (4.0 if y[0] == 1 else -4.0)
        return Gam([np.zeros(0)] * d, [np.zeros(1)] * d, [], [], [], prior)
    p = y.mean()
    prior = float(np.log(p / (1 - p)))
    cuts = [_edges(x[:, j], bins) for j in range(d)]
    binned = [np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    f = np.full(n, prior)

    def residual():
        q = 1 / (1 + np.exp(-f))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            if len(cuts[j]):
                step = rate * _shallow_tree(binned[j], *residual(), len(tables[j]), leaves, l2)
                tables[j] += step
                f += step[binned[j]]
    coarse_cuts = [_edges(x[:, j], pair_bins) for j in range(d)]
    coarse = [np.searchsorted(coarse_cuts[j], x[:, j], "left") for j in range(d)]
    sizes = [len(c) + 1 for c in coarse_cuts]
    g, h = residual()

    def cell(a, b, g, h):
        at = coarse[a] * sizes[b] + coarse[b]
        m = sizes[a] * sizes[b]
        return at, np.bincount(at, g, m), np.bincount(at, h, m)

    gains = []
    for a in range(d):
        for b in range(a + 1, d):
            _, cg, ch = cell(a, b, g, h)
            gains.append((float((cg**2 / (ch + l2)).sum()), a, b))
    pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(pairs):
            at, cg, ch = cell(a, b, *residual())
            # depth two: the best cut of each axis, four cells
            cg, ch = cg.reshape(sizes[a], sizes[b]), ch.reshape(sizes[a], sizes[b])
            step = _quarter(cg, ch, l2) * rate
            pair_tables[k] += step
            f += step.ravel()[at]
    return Gam(cuts, tables, pairs, coarse_cuts, pair_tables, prior)


def _quarter(cg: np.ndarray, ch: np.ndarray, l2: float) -> np.ndarray:
    """Table of the best split into four quarters by one cut on each axis."""
    g, h = cg.cumsum(0).cumsum(1), ch.cumsum(0).cumsum(1)
    ga, gb, gt = g[:-1, -1:], g[-1:, :-1], g[-1, -1]
    ha, hb, ht = h[:-1, -1:], h[-1:, :-1], h[-1, -1]
    gc, hc = g[:-1, :-1], h[:-1, :-1]
    if not gc.size:
        return np.zeros(cg.shape)
    quarters = [(gc, hc), (ga - gc, ha - hc), (gb - gc, hb - hc), (gt - ga - gb + gc, ht - ha - hb + hc)]
    i, j = np.unravel_index(sum(a**2 / (b + l2) for a, b in quarters).argmax(), gc.shape)
    out = np.empty(cg.shape)
    for (a, b), place in zip(quarters, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), strict=True):
        out[place] = a[i, j] / (b[i, j] + l2)
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Gam:
    x, y = training_matrix(labelled_sample(docs, labels, "quality", ~held_out(FOLD, HELD), sample_rows))
    return fit_gam(x, y)


def classify(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for b in chunks(batches):
            score = model.score(stats_of(b.column("text").to_pylist())[1])
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(FOLD, HELD).alias("held_out"), "text")
    return with_text(src).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def filter_docs(docs: DataFrame, model: Gam, keep_at: float = 0.5) -> DataFrame:
    """The rows of docs that score at least keep_at, all columns unchanged."""

    def run(batches):
        for b in chunks(batches):
            yield b.filter(pa.array(model.score(stats_of(b.column("text").to_pylist())[1]) >= keep_at))

    return with_text(docs).mapInArrow(run, T.StructType(docs.schema.fields))
