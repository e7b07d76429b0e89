"""SentencePiece encoding and decoding, with a parallel scan over giant documents.

A document up to `GIANT` characters is encoded where it is read. A longer one is cut into chunks that
other tasks take. What a chunk does to the segmentation is a transfer matrix over boundary states in the
(max, +) semiring: an entry is the best score of going from a state at its start to a state at its end.
Matrices of one document are combined associatively (a tree of products, then prefixes and suffixes), which fixes the state at
every cut; each chunk is then backtraced on its own between the states found.

* Unigram models: a state is how many characters the piece over the cut reaches beyond it; scores are the
  pieces' log probabilities.
* BPE models have no additive score. There a state is the very piece over the cut, and scores are 0 or
  minus infinity: a sequence of pieces is the BPE result exactly when every two neighbours encode to
  themselves, so the one path of score 0 is the encoding. Pieces never hold a space after another
  character, so a cut before a space has one state and its chunks need no matrix.

The pieces come from the model file, whose bytes travel with the task; nothing is trained. Models that
normalise (a character map, or spaces removed) are refused.

Defined cases: null and empty texts have no pieces; a document's unbroken run of any length is cut as
well; unknown characters become byte pieces where the model has them, else the unknown piece; rows that
repeat are encoded each; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, with_text
from .textstats import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT, CHUNK = 65536, 16384
SPACE = "▁"
NEVER = -math.inf
#: Fixed values of the public model format: field numbers and kinds.
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6

State = tuple[int, int]  # where the piece over a cut starts and ends, relative to the cut
Matrix = dict[tuple[State, State], float]
FRESH: State = (0, 0)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Pieces:
    """Scores and ids of a model's normal pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    kind: int
    longest: int
    clean_spaces: bool
    unknown: int = 0
    unknown_score: float = -20.0

    @classmethod
    def of(cls, ids: dict[str, int], scores: dict[str, float], kind: int) -> Pieces:
        longest = max(map(len, ids), default=1)
        low = min(scores.values(), default=0.0) - 10.0  # the library's penalty of an unknown character
        return cls(ids, scores, kind, longest, not any(SPACE in p.lstrip(SPACE) for p in ids), 0, low)

    @classmethod
    def load(cls, proto: bytes) -> Pieces:
        ids, scores, kind, n = {}, {}, _UNIGRAM, 0
        for field, value in _fields(proto):
            if field == 1:
                piece = dict(_fields(value))
                if piece.get(3, _NORMAL) == _NORMAL:
                    text = piece[1].decode()
                    ids[text], scores[text] = n, struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                n += 1
            elif field == 2:
                kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without a character map that keep all spaces are supported")
        return cls.of(ids, scores, kind)


class Encoder:
    """Encodes texts by the library and gives the transfer matrices of chunks."""

    def __init__(self, proto: bytes):
        import sentencepiece as spm

        self.sp = spm.SentencePieceProcessor(model_proto=proto)
        # a second normalizer_spec (field 3) merges with the first: here, add_dummy_prefix (its field 3) = false
        self.raw = spm.SentencePieceProcessor(model_proto=proto + bytes((3 << 3 | 2, 2, 3 << 3, 0)))
        self.pieces = Pieces.load(proto)
        self.neighbours = lru_cache(1 << 18)(self._neighbours)

    def _neighbours(self, a: str, b: str) -> bool:
        """Whether BPE leaves these two pieces (or unknown characters) as they are; with a = "" the one piece."""
        ids = self.pieces.ids
        want = [ids[x] for x in (a, b) if x in ids]
        if len(want) < bool(a) + 1:
            return all(self.raw.encode(x.replace(SPACE, " ")) == [ids[x]] for x in (a, b) if x in ids)
        return self.raw.encode((a + b).replace(SPACE, " ")) == want

    def transfer(self, left: str, body: str, right: str, ins: list[State] | None, outs_clean: bool) -> Matrix:
        f = unigram_transfer if self.pieces.kind == _UNIGRAM else bpe_transfer
        return f(self, left, body, right, ins, outs_clean)


#: What a clean cut leaves whole: spaces and what follows them up to the next space.
_SEGMENT = re.compile(" +[^ ]*")
MOST_CACHED = 400_000


class _Index(dict):
    """Numbers new keys in order and remembers them."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class SegmentEncoder:
    """Encodes many texts by their segments between clean cuts; each distinct segment meets the library once."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.clean = enc.pieces.clean_spaces and enc.pieces.kind == _BPE
        self._reset()

    def _reset(self) -> None:
        self.index, self.flat, self.start = _Index(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> pa.Array:
        if not self.clean:
            return pa.array(self.enc.sp.encode(texts, num_threads=1), pa.list_(pa.int32()))
        if len(self.index) > MOST_CACHED or len(self.flat) > 8 * MOST_CACHED:
            self._reset()
        found = [_SEGMENT.findall(" " + t) if t else () for t in texts]
        count = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(self.index.__getitem__, itertools.chain.from_iterable(found)), np.int64, int(count.sum()))
        if self.index.new:
            ids = self.enc.raw.encode(self.index.new, num_threads=1)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate((self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size.sum()))))
            self.start = np.concatenate((self.start, self.start[-1] + size.cumsum()))
            self.index.new.clear()
        return _gather(self.flat, self.start, at, count)


def _gather(flat: np.ndarray, start: np.ndarray, at: np.ndarray, count: np.ndarray) -> pa.Array:
    """Lists of the concatenated entries `at` of a ragged table, `count` entries a list."""
    size = start[at + 1] - start[at]
    ends = np.concatenate(([0], size.cumsum()))
    values = flat[np.repeat(start[at] - ends[:-1], size) + np.arange(ends[-1])]
    offsets = ends[np.concatenate(([0], count.cumsum()))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


class Decoder:
    """Decodes by a table of each piece's bytes; texts whose bytes aren't UTF-8 are left to the library."""

    def __init__(self, proto: bytes):
        import sentencepiece as spm

        self.sp = sp = spm.SentencePieceProcessor(model_proto=proto)
        table, self.led = [], []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.led.append(piece[:1] == SPACE)
            table.append(b"" if sp.is_control(i) else bytes((int(piece[3:-1], 16),)) if sp.is_byte(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else piece.replace(SPACE, " ").encode())
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.start = np.concatenate(([0], np.cumsum([len(b) for b in table])))

    def decode(self, ids: pa.Array) -> list[str | None]:
        count = np.diff(ids.offsets.to_numpy())
        at = ids.flatten().to_numpy().astype(np.int64)
        raw = _gather(self.flat, self.start, at, count)
        data, off = raw.values.to_numpy().tobytes(), raw.offsets.to_numpy().tolist()
        valid = ids.is_valid().to_pylist()
        first = np.concatenate(([0], count.cumsum()))
        out: list[str | None] = []
        for i, ok in enumerate(valid):
            if not ok:
                out.append(None)
                continue
            b, own = data[off[i] : off[i + 1]], at[first[i] : first[i + 1]]
            try:
                if len(own) and self.sp.is_control(int(own[0])):
                    out.append(self.sp.decode(own.tolist()))
                else:
                    # without the prefix that encoding adds
                    out.append((b[1:] if len(own) and self.led[own[0]] else b).decode())
            except UnicodeDecodeError:
                out.append(self.sp.decode(own.tolist()))
        return out


def straddling(pieces: Pieces, left: str, right: str) -> list[State]:
    """All pieces (and single characters) that end at a cut or reach over it."""
    out = []
    for before in range(1, min(pieces.longest, len(left)) + 1):
        for after in range(0, min(pieces.longest - before, len(right)) + 1):
            p = left[len(left) - before :] + right[:after]
            if p in pieces.ids or len(p) == 1:
                out.append((-before, after))
    return out


def bpe_transfer(enc: Encoder, left: str, body: str, right: str, ins: list[State] | None, outs_clean: bool) -> Matrix:
    """0 for each pair of states that one valid sequence of pieces joins. None: the start is a clean cut."""
    text, base, n = left + body + right, len(left), len(body)
    longest, known, ok = enc.pieces.longest, enc.pieces.ids, enc.neighbours
    stop = min(len(text), base + n + longest)
    matrix: Matrix = {}
    first: dict[int, str] | None = None
    for state in ins if ins is not None else [FRESH]:
        start = base + state[1]
        lead = text[base + state[0] : start] if state != FRESH else ""
        if lead and not ok("", lead):
            continue
        last: dict[int, str] = {start: lead}
        alike = 0
        for end in range(start + 1, stop + 1):
            for size in range(min(longest, end - start), 0, -1):
                p = text[end - size : end]
                before = last.get(end - size)
                if before is not None and (size == 1 or p in known) and ok(before, p):
                    last[end] = p
                    break
            if first is not None:
                alike = alike + 1 if first.get(end) == last.get(end) and end in last else 0
                if alike > longest:  # from here on both runs are the same
                    last |= {k: v for k, v in first.items() if k > end}
                    break
        if first is None:
            first = last
        for end, p in last.items():
            at = (end - len(p) - base - n, end - base - n)
            if outs_clean:
                if at[1] == 0 and (p or n == 0):
                    matrix[state, FRESH] = 0.0
            elif at[0] < 0 <= at[1]:
                matrix[state, at] = 0.0
    return matrix


def unigram_transfer(enc, left: str, body: str, right: str, ins: list[State] | None, outs_clean: bool) -> Matrix:
    """Best scores between overhangs; a state (0, k) is k characters beyond the cut."""
    pieces: Pieces = enc.pieces
    text, n = body + right, len(body)
    matrix: Matrix = {}
    for state in ins if ins is not None else [FRESH]:
        start = state[1]
        if start > n:
            matrix[state, (0, start - n)] = 0.0
            continue
        best, _ = unigram_best(pieces, text, start, n)
        for end, score in best.items():
            if end >= n and (end == n or not outs_clean):
                matrix[state, (0, end - n)] = score
    return matrix


def unigram_best(pieces: Pieces, text: str, start: int, n: int) -> tuple[dict[int, float], dict[int, int]]:
    """Best score and last start by end, for pieces that start in [start, n)."""
    best, back = {start: 0.0}, {}
    for at in range(start, n):
        if at not in best:
            continue
        for size in range(1, min(pieces.longest, len(text) - at) + 1):
            p = text[at : at + size]
            score = pieces.scores.get(p, pieces.unknown_score if size == 1 else None)
            if score is not None and best[at] + score > best.get(at + size, NEVER):
                best[at + size], back[at + size] = best[at] + score, at
    return best, back


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    by_in: dict[State, list[tuple[State, float]]] = {}
    for (i, o), s in b.items():
        by_in.setdefault(i, []).append((o, s))
    out: Matrix = {}
    for (i, m), s in a.items():
        for o, t in by_in.get(m, ()):
            if s + t > out.get((i, o), NEVER):
                out[i, o] = s + t
    return out


def resolve(matrices: list[Matrix], last: State = FRESH) -> list[State]:
    """The state at every cut (first and last included) on the best path, by a tree of products.

    The middle state of a span is the best one given the states at its ends; both halves then follow alone.
    """
    tree: dict[tuple[int, int], Matrix] = {}

    def build(a: int, z: int) -> Matrix:
        if z - a == 1:
            tree[a, z] = matrices[a]
        else:
            m = (a + z) // 2
            tree[a, z] = product(build(a, m), build(m, z))
        return tree[a, z]

    states: list[State] = [FRESH] * (len(matrices) + 1)
    if not matrices:
        return [FRESH]
    build(0, len(matrices))
    states[-1] = last
    todo = [(0, len(matrices))]
    while todo:
        a, z = todo.pop()
        if z - a == 1:
            continue
        m = (a + z) // 2
        right = {i: s for (i, o), s in tree[m, z].items() if o == states[z]}
        best = max(((s + right[o], o) for (i, o), s in tree[a, m].items() if i == states[a] and o in right), key=lambda x: x[0], default=None)
        if best is None:
            raise ValueError("no segmentation joins these chunks")
        states[m] = best[1]
        todo += [(a, m), (m, z)]
    return states


def cut_points(text: str, chunk: int, clean: bool) -> list[tuple[int, bool]]:
    """(position, clean) of cuts; a clean cut stands before a space that follows another character."""
    out, at = [], 0
    while len(text) - at > chunk:
        to = at + chunk
        p = text.rfind(SPACE, at + chunk // 2, to + 1) if clean else -1
        while p > 0 and text[p - 1] == SPACE:
            p -= 1
        if p > at + chunk // 2:
            out.append((p, True))
            at = p
        else:
            out.append((to, False))
            at = to
    return out


def normalized(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def split_giant(pieces: Pieces, text: str, chunk: int = CHUNK) -> list[tuple[str, str, str, bool, bool]]:
    """(left context, body, right context, clean start, clean end) of each chunk of a normalised text."""
    cuts = [(0, True), *cut_points(text, chunk, pieces.clean_spaces), (len(text), True)]
    side = pieces.longest
    return [(text[max(0, a - side) : a], text[a:z], text[z : z + side], ca, cz) for (a, ca), (z, cz) in zip(cuts, cuts[1:], strict=False)]


def chunk_matrix(enc: Encoder, left: str, body: str, right: str, clean_in: bool, clean_out: bool) -> Matrix:
    if clean_in and clean_out and enc.pieces.kind == _BPE:
        return {(FRESH, FRESH): 0.0}
    if clean_in:
        ins = None
    elif enc.pieces.kind == _BPE:
        ins = straddling(enc.pieces, left, body + right)
    else:
        ins = [(0, k) for k in range(enc.pieces.longest)]
    return enc.transfer(left, body, right, ins, clean_out)


def chunk_ids(enc: Encoder, body: str, right: str, start: State, end: State) -> list[int]:
    """Pieces of a chunk between the states at its two cuts; a piece over a cut belongs to the chunk where it starts."""
    text = (body + right)[start[1] : len(body) + end[1]]
    if enc.pieces.kind == _BPE:
        return enc.raw.encode(text.replace(SPACE, " "))
    n = len(body) - start[1]
    if n <= 0:
        return []
    _, back = unigram_best(enc.pieces, text, 0, n)
    out, at = [], len(text)
    while at > 0:
        out.append(enc.pieces.ids.get(text[back[at] : at], enc.pieces.unknown))
        at = back[at]
    return out[::-1]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _pack(m: Matrix) -> str:
    return json.dumps([[*i, *o, s] for (i, o), s in m.items()])


def _unpack(text: str) -> Matrix:
    return {((a, b), (c, d)): s for a, b, c, d, s in json.loads(text)}


def encode(docs: DataFrame, model_path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """docs with ids array<int>: the pieces of the whole text. decoded: with their text too, in the same pass."""
    proto = _read(model_path)
    fields = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")[: 1 + decoded]]
    docs = with_text(docs).select(*[F.col(f"`{f.name}`") for f in fields])
    out_schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded])

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = SegmentEncoder(Encoder(proto)), Decoder(proto) if decoded else None
        for b in chunks(batches, 128):
            ids = enc.encode([t or "" for t in b.column("text").to_pylist()])
            back = [pa.array(dec.decode(ids), pa.string())] if dec else []
            yield pa.RecordBatch.from_arrays([*b.columns, ids, *back], names=[*b.schema.names, "ids", *["decoded"] * decoded])

    length = F.coalesce(F.length("text"), F.lit(0))
    small = docs.where(length <= giant).mapInArrow(direct, out_schema)
    large = docs.where(length > giant)
    if large.isEmpty():
        return small
    giants = _encode_giants(large, proto, chunk)
    return small.unionByName(decode(giants, model_path) if decoded else giants)


def _encode_giants(large: DataFrame, proto: bytes, chunk: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(proto)
        for b in chunks(batches, 1):
            parts = split_giant(pieces, normalized(b.column("text").to_pylist()[0]), chunk)
            key = b.column("key").to_pylist()[0]
            cols = list(zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), *(pa.array(c, pa.string()) for c in cols[:3]), *(pa.array(c, pa.bool_()) for c in cols[3:])],
                names=["key", "k", "left", "body", "right", "cin", "cout"],
            )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(proto)
        for b in batches:
            rows = b.to_pylist()
            m = [_pack(chunk_matrix(enc, r["left"], r["body"], r["right"], r["cin"], r["cout"])) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), pa.array(m, pa.string())], names=["key", "k", "m"])

    def states(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["k"])
        got = resolve([_unpack(r["m"]) for r in rows])
        ends = [(a, b) for a, b in zip(got, got[1:], strict=False)]
        n = len(rows)
        return pa.table({"key": pa.array([rows[0]["key"]] * n, pa.string()), "k": pa.array(range(n), pa.int32()), "a0": [a[0] for a, _ in ends], "a1": [a[1] for a, _ in ends], "z0": [z[0] for _, z in ends], "z1": [z[1] for _, z in ends]})

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(proto)
        for b in batches:
            ids = [chunk_ids(enc, r["body"], r["right"], (r["a0"], r["a1"]), (r["z0"], r["z1"])) for r in b.select(["body", "right", "a0", "a1", "z0", "z1"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "k", "ids"])

    # two hashes and the length: giants of equal text are encoded once, others never share a key
    keyed = large.withColumn("_pieces_key", F.concat_ws("-", F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), "text")), F.length("text").cast("string")))
    texts = keyed.groupBy(F.col("_pieces_key").alias("key")).agg(F.min("text").alias("text"))
    parts = materialize(texts.mapInArrow(split, "key string, k int, left string, body string, right string, cin boolean, cout boolean").repartition("key", "k"), "pieces-chunks")
    at = materialize(parts.mapInArrow(matrices, "key string, k int, m string").groupBy("key").applyInArrow(states, "key string, k int, a0 long, a1 long, z0 long, z1 long"), "pieces-states")
    done = parts.join(at, ["key", "k"]).select("key", "k", "body", "right", "a0", "a1", "z0", "z1").mapInArrow(backtrace, "key string, k int, ids array<int>")
    joined = done.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return keyed.join(joined.withColumnRenamed("key", "_pieces_key"), "_pieces_key").drop("_pieces_key")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """encoded with decoded string: the text of ids (null for null)."""
    proto = _read(model_path)
    fields = [f for f in encoded.schema.fields if f.name != "decoded"]
    src = encoded.select(*[F.col(f"`{f.name}`") for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(proto)
        for b in chunks(batches, 128):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoder.decode(b.column("ids")), pa.string())], names=[*b.schema.names, "decoded"])

    return with_text(src).mapInArrow(run, T.StructType([*fields, T.StructField("decoded", T.StringType())]))
