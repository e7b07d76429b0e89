"""Quality rules: gradient-boosted trees over document statistics.

Trees of fixed depth are grown level by level on a histogram of quantile bins with logistic loss. Chosen
features carry monotonic constraints: a split that breaks one is refused, and each child's value is held
on its side of the middle of the pair's values, so the sum of trees is monotonic. The forest is flattened into numpy node
arrays (feature, threshold, left child, value), and a batch walks all trees by array look-ups.

Labels come from at most `sample_rows` labelled documents (those of least id hash), whatever the corpus.
A document is kept unless its base check fails or the forest's score is under `keep_at`.

Defined cases: a null text has no words, so its base check fails; nulls in other columns, repeated rows
and extra columns pass through unread; with no labelled rows or one class, the score is the prior (1
without any labels), so only the base check decides; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample, with_text
from .textstats import BASE, FEATURES, chunks, stats_of, training_matrix

SAMPLE_ROWS = 8000
KEEP_AT = 0.5
#: More junk must never raise the score (-1).
MONOTONE = {"symbol_ratio": -1, "symbol_words": -1, "repeat_ratio": -1, "run_ratio": -1, "dup_line_ratio": -1, "exclaim_ratio": -1, "pipe_ratio": -1}


@dataclass
class Forest:
    """Node arrays over all trees; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray  # the right child follows the left one
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[node]] > self.threshold[node]
            inner = self.left[node] >= 0
            node = np.where(inner, self.left[node] + right, node)
        return 1 / (1 + np.exp(-(self.prior + self.value[node].sum(axis=1))))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: int = 12, l2: float = 2.0) -> Forest:
    monotone = monotone or {}
    n = len(y)
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 1 - 1e-9
    prior = float(np.log(p / (1 - p)))
    feature, threshold, left, value, roots = [0], [0.0], [-1], [0.0], []
    if n == 0 or y.min() == y.max():
        return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array([0]), 0, prior)
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], axis=1)
    sign = np.array([monotone.get(j, 0) for j in range(d)])
    f = np.full(n, prior)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-f))
        g, h = y - prob, prob * (1 - prob)
        roots.append(len(feature))
        feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
        todo = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for level in range(depth + 1):
            nxt = []
            for node, rows, lo, hi in todo:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = rate * float(np.clip(gs / (hs + l2), lo, hi))
                if level == depth or len(rows) < 2 * least:
                    continue
                best = (1e-6, -1, -1, 0.0, 0.0)
                for j in range(d):
                    m = len(cuts[j]) + 1
                    if m < 2:
                        continue
                    b = binned[rows, j]
                    cg, ch, cn = (np.bincount(b, w, m).cumsum()[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = cg / (ch + l2), (gs - cg) / (hs - ch + l2)
                    gain = cg**2 / (ch + l2) + (gs - cg) ** 2 / (hs - ch + l2) - gs**2 / (hs + l2)
                    ok = (cn >= least) & (len(rows) - cn >= least)
                    if sign[j]:
                        ok &= sign[j] * (vr - vl) >= 0
                    gain = np.where(ok, gain, -1)
                    if gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), j, k, float(np.clip(vl[k], lo, hi)), float(np.clip(vr[k], lo, hi)))
                _, j, k, vl, vr = best
                if j < 0:
                    continue
                at = len(feature)
                feature[node], threshold[node], left[node] = j, float(cuts[j][k]), at
                mid = (vl + vr) / 2
                for child in range(2):
                    feature.append(0), threshold.append(0.0), left.append(-1), value.append(0.0)
                    side = rows[(binned[rows, j] > k) == bool(child)]
                    bound = (lo, hi)
                    if sign[j]:
                        bound = (lo, min(hi, mid)) if (child == 0) == (sign[j] > 0) else (max(lo, mid), hi)
                    nxt.append((at + child, side, *bound))
            todo = nxt
        tree = Forest(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots[-1:]), depth, 0.0)
        s = tree.score(x)
        f = f + np.log(s / (1 - s))
    return Forest(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), depth, prior)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    x, y = training_matrix(labelled_sample(docs, labels, "quality", F.lit(True), sample_rows))
    return fit_forest(x, y, {FEATURES.index(k): v for k, v in MONOTONE.items()})


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


def apply_rules(docs: DataFrame, forest: Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the five base statistics, base_failed, rule_score, kept."""

    def run(batches):
        for b in chunks(batches):
            base, x = stats_of(b.column("text").to_pylist())
            score = forest.score(x)
            bad = base_failed(base)
            cols = [b.column("doc_id"), *(pa.array(c) for c in base.T), pa.array(bad), pa.array(score), pa.array(~bad & (score >= keep_at))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE, "base_failed", "rule_score", "kept"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, rule_score double, kept boolean"
    return with_text(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def filter_docs(docs: DataFrame, forest: Forest, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the rules keep, all columns unchanged, in one pass."""

    def run(batches):
        for b in chunks(batches):
            base, x = stats_of(b.column("text").to_pylist())
            yield b.filter(pa.array(~base_failed(base) & (forest.score(x) >= keep_at)))

    return with_text(docs).mapInArrow(run, T.StructType(docs.schema.fields))
