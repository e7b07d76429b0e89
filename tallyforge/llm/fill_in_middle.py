"""Fill-in-the-middle: texts are cut at two random token boundaries and their parts set in another order.

Tokens are runs of ASCII letters and single other characters, so a token starts at every character but a
letter that follows a letter: whether one starts is told by two neighbours. A text is cut into chunks that
overlap by that one character; every chunk counts its starts alone, prefix sums of the counts tell which
chunks hold the two cut ranks, and only those are looked through again for the place of the cut.

Texts of up to `GIANT` chunks are counted where their row lies. Chunks of longer ones are dealt over the
cluster as rows of their own (`_dealt`), the prefix sums are a window over counts, and only numbers come back to the row.
Output and rebuilt text are JVM expressions.

Cuts, form and order come from sha256 of "seed:doc_id", so they don't depend on how rows lie.

Defined cases: a null text is an empty one; an empty text, and one that holds a sentinel, stays plain; a row
without doc_id is cut by the hash of "seed:"; repeated rows are each transformed; a text that is one
token gives empty parts; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_text
from .textstats import chunks as slices

#: Characters of a chunk, and the chunks up to which a text is counted in one piece of work.
CHUNK, GIANT = 65_536, 64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Of a hundred transformed or not: kept plain from here on; of a hundred transformed: suffix first below this.
PLAIN_FROM, SPM_BELOW = 90, 20


def starts(piece: str, overlap: int) -> np.ndarray:
    """By character of a chunk after its first `overlap` (0 or 1) ones, whether a token starts there."""
    code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((code | 32) - np.uint32(97)) < 26
    if overlap:
        return ~(letter[1:] & letter[:-1])
    first = np.ones(min(1, len(code)), bool)
    return np.concatenate((first, ~(letter[1:] & letter[:-1])))


def pieces(text: str, chunk: int) -> Iterator[tuple[int, str]]:
    """(overlap, chunk with the character before it) in order."""
    for at in range(0, len(text), chunk):
        before = 1 if at else 0
        yield before, text[at - before : at + chunk]


def cut_places(text: str, h1: int, h2: int, chunk: int) -> tuple[int, int, int]:
    """(tokens, end of the prefix, end of the middle), ends in characters."""
    count = np.array([int(starts(p, o).sum()) for o, p in pieces(text, chunk)], np.int64)
    upto = count.cumsum()
    n = int(upto[-1]) if len(upto) else 0
    ends = []
    for rank in sorted((h1 % (n + 1), h2 % (n + 1))):
        if rank == n:  # all tokens lie before the cut
            ends.append(len(text))
            continue
        owner = int(np.searchsorted(upto, rank, side="right"))
        at = owner * chunk
        piece = text[max(0, at - 1) : at + chunk]
        ends.append(at + int(np.flatnonzero(starts(piece, min(1, at)))[rank - (upto[owner] - count[owner])]))
    return n, ends[0], ends[1]


def _hash(k: int, seed: str) -> Column:
    """The k-th group of eight hex digits, from 1, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _here(chunk: int):
    @F.pandas_udf("n long, a long, b long")
    def cut(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_places(t, x, y, chunk) for t, x, y in zip(text, h1, h2, strict=True)], columns=["n", "a", "b"], dtype="int64")

    return cut(F.col("text"), F.col("_h1"), F.col("_h2"))


#: What names a giant text: rows that agree in all of it have the same cuts.
_KEY = ("_id", "_s")


def _dealt(giants: DataFrame, chunk: int) -> DataFrame:
    """giants with _c (n, a, b): their chunks are rows that any task may count, dealt by text and number."""
    keyed = giants.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("_s", F.sha2("text", 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            i, s, text = (b.column(c)[0].as_py() for c in ("_id", "_s", "text"))
            for k, (overlap, piece) in enumerate(pieces(text, chunk)):
                yield pa.RecordBatch.from_pydict({"_id": [i], "_s": [s], "k": [k], "overlap": [overlap], "piece": [piece]}, schema)

    schema = pa.schema([("_id", pa.string()), ("_s", pa.string()), ("k", pa.int64()), ("overlap", pa.int32()), ("piece", pa.string())])
    rows = keyed.select("_id", "_s", "text").mapInArrow(cut, "_id string, _s string, k long, overlap int, piece string")
    parts = materialize(rows.repartition(*_KEY, "k"), "fim-chunks")

    @F.pandas_udf("long")
    def counted(piece: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([int(starts(p, o).sum()) for p, o in zip(piece, overlap, strict=True)], dtype="int64")

    @F.pandas_udf("long")
    def place(piece: pd.Series, overlap: pd.Series, nth: pd.Series) -> pd.Series:
        return pd.Series([int(np.flatnonzero(starts(p, o))[r]) for p, o, r in zip(piece, overlap, nth, strict=True)], dtype="int64")

    counts = parts.select(*_KEY, "k", counted("piece", "overlap").alias("c"), (F.length("piece") - F.col("overlap")).cast("long").alias("len"))
    counts = materialize(counts.groupBy(*_KEY, "k").agg(F.max("c").alias("c"), F.max("len").alias("len")), "fim-counts")  # copies of a text cut alike
    before = F.sum("c").over(Window.partitionBy(*_KEY).orderBy("k")) - F.col("c")
    total = counts.groupBy(*_KEY).agg(F.sum("c").alias("n"), F.sum("len").alias("chars"))
    ranks = keyed.select(*_KEY, "_h1", "_h2").distinct().join(total, [*_KEY])
    r1, r2 = (F.col(h) % (F.col("n") + 1) for h in ("_h1", "_h2"))
    ranks = ranks.select(*_KEY, "n", "chars", F.least(r1, r2).alias("ra"), F.greatest(r1, r2).alias("rb"))
    asked = F.explode(F.expr("filter(array(struct('a' as cut, ra as rank), struct('b' as cut, rb as rank)), x -> x.rank < n)"))
    owners = (
        ranks.select(*_KEY, "n", asked.alias("x")).join(counts.withColumn("before", before), [*_KEY])
        .where("x.rank >= before and x.rank < before + c").select(*_KEY, "k", "x.cut", (F.col("x.rank") - F.col("before")).alias("nth"))
    )
    found = (
        parts.dropDuplicates([*_KEY, "k"]).join(owners, [*_KEY, "k"]).select(*_KEY, "cut", (F.col("k") * chunk + place("piece", "overlap", "nth")).alias("at"))
        .groupBy(*_KEY).agg(F.max(F.when(F.col("cut") == "a", F.col("at"))).alias("a"), F.max(F.when(F.col("cut") == "b", F.col("at"))).alias("b"))
    )
    cuts = ranks.join(found, [*_KEY], "left").select(*_KEY, F.struct("n", F.coalesce("a", "chars").alias("a"), F.coalesce("b", "chars").alias("b")).alias("_c"))
    return keyed.join(cuts, [*_KEY]).drop(*_KEY)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Sentinels stand in outputs of the two orders only, each once."""
    part = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, seed: str = SEED, chunk: int = CHUNK, giant: int = GIANT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output (the text to train on)."""
    d = with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    d = d.withColumns({f"_h{k}": _hash(k, seed) for k in (1, 2, 3, 4)})
    long = F.length("text") > chunk * giant
    cuts = d.where(~long).withColumn("_c", _here(chunk))
    giants = d.where(long)
    if not giants.isEmpty():
        cuts = cuts.unionByName(_dealt(giants, chunk))
    text, a, b = F.col("text"), F.col("_c.a"), F.col("_c.b")
    stays = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (F.col("_h3") % 100 >= PLAIN_FROM)
    form = F.when(stays, "plain").when(F.col("_h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    part = lambda at, size: F.substr(text, (at + 1).cast("int"), size.cast("int"))
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.length(text) - b)
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    moved = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    changed = F.col("form") != "plain"
    return cuts.withColumn("form", form).select("doc_id", F.col("_c.n").alias("n"), "form", F.when(changed, a).alias("prefix_chars"), F.when(changed, b - a).alias("middle_chars"), moved.alias("output"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """transform with hashes of the output and of the text rebuilt from it, instead of the output."""
    t = transform(docs, **options)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: The rows of digests for DuckDB: tokens as a list, parts by slices of it.
ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tok, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents
), g AS (
  SELECT doc_id, text, tok, len(tok) AS n, cast('0x' || substr(h, 1, 8) AS bigint) AS h1, cast('0x' || substr(h, 9, 8) AS bigint) AS h2, cast('0x' || substr(h, 17, 8) AS bigint) AS h3, cast('0x' || substr(h, 25, 8) AS bigint) AS h4 FROM d
), f AS (
  SELECT doc_id, text, tok, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), s AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(tok, 1, a), '') AS p, array_to_string(list_slice(tok, a + 1, b), '') AS m, array_to_string(list_slice(tok, b + 1, n), '') AS s FROM f
)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN cast(length(p) AS bigint) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(m) AS bigint) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM s
"""
