"""License scan by a positional index over each licence template's rarest words.

Templates are passages that licences and notices are known by. How rare their words are is counted over all documents.
The index posts, for every template, its `RARE` words of highest IDF with their positions. A file's words are looked up in it: a word at
place p that a template has at position j votes for that template beginning at p - j. Where the votes of
different words meet within `DRIFT` places, so that some words may be missing or put in, and at least the share `AGREE` of the
posted words do, the template is a candidate there. It is found if each of its mandatory phrases stands, whole, where it
should, and words of at least the share `COVER` of its total IDF do.

Beside it stand the base places: wherever the words of a base phrase follow each other.

Files are looked through where they lie, twice (words of templates are counted first); what moves are counts for
each word of the templates, a few hundred rows of a task. A text is cut into words a piece at a time; only places of template words are kept.

Defined cases: a null text is an empty one and has no word; rows that repeat are scanned each; a row without
doc_id too; templates that overlap are all found; without any label both label columns are empty strings and score is 0; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text
from .textstats import chunks

RARE, AGREE, DRIFT, COVER = 8, 0.6, 6, 0.8
#: The score of a file that only base phrases speak for.
BASE_SCORE = 0.5
#: Bytes of text cut into words at once.
PIECE = 1 << 20

#: Fixed by the contract: phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, passage, mandatory phrases of it. Passages are quoted from the public licences and their usual notices.
TEMPLATES = [
    ("mit", "under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses license 2 0"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["for any purpose with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("epl-2.0", "under the terms of the eclipse public license v 2 0", ["eclipse public license v 2 0"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["including commercial applications and to alter it and redistribute it freely"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0 international"]),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0 international"]),
]

#: Bytes as words see them: A-Z lower, everything of ASCII but letters and digits a space, bytes of other characters as they are.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]] = field(default_factory=list)  # (position, words)


def read_templates(given=tuple(TEMPLATES)) -> list[Template]:
    out = []
    for label, passage, keys in given:
        words = passage.encode().split()
        t = Template(label, words)
        for k in keys:
            key = k.encode().split()
            at = next((i for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key), None)
            if at is None:
                raise ValueError(f"{k!r} isn't part of its template")
            t.keys.append((at, key))
        out.append(t)
    return out


def vocabulary(templates: list[Template], base: dict[str, str]) -> dict[bytes, int]:
    """Numbers of all words that templates and base phrases hold."""
    return {w: i for i, w in enumerate(sorted({w for t in templates for w in t.words} | {w for p in base for w in p.encode().split()}))}


def hits(text: str, vocab: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """(words of the text, places of vocabulary words in order, their numbers)."""
    raw = text.encode("utf-8", "surrogatepass").translate(_BYTES)
    n, at, places, numbers = 0, 0, [], []
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        words = raw[at : end if end >= 0 else len(raw)].split()
        v = np.fromiter((vocab.get(w, -1) for w in words), np.int64, len(words))
        p = np.flatnonzero(v >= 0)
        places.append(p + n)
        numbers.append(v[p])
        n, at = n + len(words), end if end >= 0 else len(raw)
    return n, np.concatenate([*places, np.zeros(0, np.int64)]), np.concatenate([*numbers, np.zeros(0, np.int64)])


class Index:
    """Postings of the templates' rarest words; idf by vocabulary number."""

    def __init__(self, templates: list[Template], vocab: dict[bytes, int], idf: np.ndarray, rare: int = RARE, agree: float = AGREE, drift: int = DRIFT, cover: float = COVER):
        self.drift, self.cover, self.idf = drift, cover, idf
        self.labels = [t.label for t in templates]
        self.words = [np.array([vocab[w] for w in t.words], np.int64) for t in templates]
        self.keys = [[(at, [vocab[w] for w in key]) for at, key in t.keys] for t in templates]
        self.need = np.zeros(len(templates), np.int64)
        post: list[tuple[int, int, int, int]] = []  # word, template, position, bit
        for t, w in enumerate(self.words):
            rarest = sorted(set(w.tolist()), key=lambda v: (-idf[v], v))[: min(rare, 63)]
            self.need[t] = math.ceil(agree * len(rarest))
            post += [(v, t, j, rarest.index(v)) for j, v in enumerate(w.tolist()) if v in rarest]
        self.post = np.array(sorted(post), np.int64).reshape(-1, 4)
        self.first = np.searchsorted(self.post[:, 0], np.arange(len(vocab) + 1))

    def votes(self, places: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, start) of candidates, in order."""
        size = self.first[numbers + 1] - self.first[numbers]
        which = np.repeat(np.arange(len(numbers)), size)
        row = self.post[np.arange(len(which)) - np.repeat(size.cumsum() - size, size) + self.first[numbers][which]]
        start = places[which] - row[:, 2]
        order = np.lexsort((start, row[:, 1]))
        t, start, bit = row[order, 1], start[order], np.int64(1) << row[order, 3]
        head = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (start[1:] != start[:-1]))) if len(t) else np.zeros(0, bool))
        if not len(head):
            return t, start
        t, start, bits = t[head], start[head], np.bitwise_or.reduceat(bit, head)
        # one number for (template, start), in the same order, to look up later starts of the template
        span = int(start.max() - start.min()) + self.drift + 1
        key = t * span + (start - start.min())
        seen = bits.copy()
        for d in range(1, self.drift + 1):
            at = np.minimum(np.searchsorted(key, key + d), len(key) - 1)
            seen |= np.where(key[at] == key + d, bits[at], 0)
        good = np.bitwise_count(seen) >= self.need[t]
        return t[good], start[good]

    def near(self, where: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether one of the sorted places lies in [start, start + drift]."""
        return np.searchsorted(where, start) < np.searchsorted(where, start + self.drift, side="right")

    def found(self, places: np.ndarray, numbers: np.ndarray) -> list[tuple[str, int, float]]:
        """(label, start, coverage) of the templates that a file holds."""
        out = []
        ts, starts = self.votes(places, numbers)
        if not len(ts):
            return out
        by_word = np.argsort(numbers, kind="stable")  # places of one word stay in order
        edge = np.searchsorted(numbers[by_word], np.arange(len(self.idf) + 1))
        of = lambda v: places[by_word[edge[v] : edge[v + 1]]]
        for t in np.unique(ts).tolist():
            s = starts[ts == t]
            for at, key in self.keys[t]:
                s = s[self.near(phrase_places(places, numbers, key), s + at)]
            if not len(s):
                continue
            weight = self.idf[self.words[t]]
            held = np.zeros(len(s))
            for j, v in enumerate(self.words[t].tolist()):
                held += weight[j] * self.near(of(v), s + j)
            share = np.round(np.minimum(held / weight.sum(), 1.0), 12)
            out += [(self.labels[t], int(a), float(c)) for a, c in zip(s, share, strict=True) if c >= self.cover]
        return sorted(out, key=lambda x: (x[1], x[0], -x[2]))


def phrase_places(places: np.ndarray, numbers: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Places where the words of a phrase stand one after the other."""
    n = len(phrase)
    if len(places) < n:
        return np.zeros(0, np.int64)
    ok = places[n - 1 :] - places[: len(places) - n + 1] == n - 1
    for i, v in enumerate(phrase):
        ok &= numbers[i : len(numbers) - n + 1 + i] == v
    return places[: len(ok)][ok]


def document_frequencies(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each word of the vocabulary), over the whole table; tasks send one row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(vocab), np.int64)
        for b in chunks(batches):
            for text in b.column("text"):
                n += 1
                df[np.unique(hits(text.as_py() or "", vocab)[2])] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], some)), pa.int64()), pa.array(np.concatenate(([n], df[some])), pa.int64())], names=["v", "n"])

    rows = with_text(docs.select("text")).mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect()  # one row a word
    df = np.zeros(len(vocab), np.int64)
    total = 0
    for r in rows:
        if r["v"] < 0:
            total = r["n"]
        else:
            df[r["v"]] = r["n"]
    return total, df


def inverse_frequencies(total: int, df: np.ndarray) -> np.ndarray:
    """Above zero for every word, so that a template always has weight."""
    return np.log((total + 2) / (df + 1))


def scan(docs: DataFrame, templates=tuple(TEMPLATES), base: dict[str, str] | None = None, rare: int = RARE, agree: float = AGREE, drift: int = DRIFT, cover: float = COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found: array of (label, start, coverage)."""
    base = BASE if base is None else base
    parsed = read_templates(templates)
    vocab = vocabulary(parsed, base)
    idf = inverse_frequencies(*document_frequencies(docs, vocab))
    index = Index(parsed, vocab, idf, rare, agree, drift, cover)
    phrases = [([vocab[w] for w in p.encode().split()], label) for p, label in base.items()]
    found_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("coverage", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("found", found_type)])

    def row(doc_id: int | None, text: str | None) -> dict:
        n, places, numbers = hits(text or "", vocab)
        at = [(phrase_places(places, numbers, p), label) for p, label in phrases]
        every = np.concatenate([p for p, _ in at] + [np.zeros(0, np.int64)])
        of_base = {label for p, label in at if len(p)}
        more = index.found(places, numbers)
        return {
            "doc_id": doc_id, "n_words": n, "n_base": len(every), "first_word": int(every.min()) if len(every) else None, "last_word": int(every.max()) if len(every) else None,
            "base_labels": ",".join(sorted(of_base)), "labels": ",".join(sorted(of_base | {x[0] for x in more})),
            "score": max([BASE_SCORE if of_base else 0.0] + [x[2] for x in more]), "found": [dict(zip(("label", "start", "coverage"), x, strict=True)) for x in more],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_pylist([row(i, t.as_py()) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)], schema)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_text(given).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label:string,start:bigint,coverage:double>>")
