"""Document statistics shared by the quality rules and the quality classifier.

All are computed from the whole text, in one pass per document, with numpy over word ids; a null text
counts as an empty one. Words are runs of anything but ASCII white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import with_text

#: Fixed by the contract: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "mean_word_chars", "symbol_ratio", "symbol_words", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "top_word_ratio",
    "upper_ratio", "digit_ratio", "punct_ratio", "exclaim_ratio", "stop_end_ratio", "long_word_ratio", "short_line_ratio", "lines_per_word",
    "mean_line_words", "run_ratio", "pipe_ratio", "alpha_words",
)
_PUNCT = re.compile(r"[.,;:?()\"']")
_DIGIT = re.compile(r"\d")
_SPACE = b" \t\n\x0b\x0c\r"


def repeat_words(ids: np.ndarray) -> int:
    """Words within 3-word windows that occur twice or more, the first occurrence included."""
    n = len(ids)
    if n < 4:
        return 0
    k = int(ids.max()) + 1
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    pair = a.astype(np.int64) * k + b
    if k > 2_000_000:  # products stay within 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * k + c
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for d in range(3):
        covered[d : n - 2 + d] |= twice
    return int(covered.sum())


def document_stats(text: str | None) -> tuple[list[int], list[float]]:
    """(BASE, FEATURES) of one text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(raw.count(bytes((s,))) for s in _SPACE)
    symbols = sum(text.count(s) for s in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeat = repeat_words(ids)
    if not n:
        return [0, 0, symbols, dup, 0], [0.0] * len(FEATURES)
    counts = np.bincount(ids)
    sizes = np.fromiter(map(len, seen), np.int64, len(seen))
    upper = sum(map(str.isupper, text))
    with_symbol = sum(c for w, c in zip(seen, counts.tolist(), strict=True) if w.strip(b"#*$%&|<>") != w)
    alpha = sum(c for w, c in zip(seen, counts.tolist(), strict=True) if w.strip(b".,;:!?\"'()").isalpha() or w[0] > 127)
    ends = sum(1 for x in lines if x.rstrip()[-1:] in b".!?\"")
    line_words = n / max(1, len(lines))
    short = sum(1 for x in lines if len(x) < 25)
    runs = int((ids[1:] == ids[:-1]).sum())
    c = max(1, chars)
    return [n, chars, symbols, dup, repeat], [
        float(np.log1p(n)), chars / n, symbols / c, with_symbol / n, dup / max(1, len(lines)), repeat / n, len(seen) / n ** 0.8, int(counts.max()) / n,
        upper / c, len(_DIGIT.findall(text)) / c, len(_PUNCT.findall(text)) / n, text.count("!") / n, ends / max(1, len(lines)), int(counts[sizes > 20].sum()) / n, short / max(1, len(lines)), len(lines) / n,
        line_words, runs / n, text.count("|") / n, alpha / n,
    ]


def stats_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n x BASE longs, n x FEATURES doubles)."""
    both = [document_stats(t) for t in texts]
    base = np.array([x[0] for x in both], np.int64).reshape(len(both), len(BASE))
    return base, np.array([x[1] for x in both], np.float64).reshape(len(both), len(FEATURES))


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of bounded size, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def training_matrix(sample) -> tuple[np.ndarray, np.ndarray]:
    """(features, y) of a bounded labelled sample, fetched as numbers, never as texts."""
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches):
        for b in chunks(batches):
            x = stats_of(b.column("text").to_pylist())[1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(c) for c in x.T)], names=["doc_id", "y", *names])

    rows = (
        with_text(sample).selectExpr("cast(doc_id as long) doc_id", "text", "cast(y as double) y")
        .mapInArrow(run, "doc_id long, y double, " + ", ".join(f"{x} double" for x in names))
        .toPandas()
        .sort_values(["doc_id", "y", *names])
    )
    return rows[names].to_numpy(np.float64).reshape(-1, len(names)), rows["y"].to_numpy(np.float64)
