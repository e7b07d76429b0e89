"""A large JSON document in parts: the objects of its one array, and what stands around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import file_system, written
from .oracle_csv import _carried
from .strict_json import FormatError, strict_loads

_ESCAPED = re.compile(r"\\.", re.S)
_SPACE = " \t\n\r"
#: A sound document has a few parts around its records; one of more is broken.
_MOST_PARTS = 100


def _ends_closed(spark: SparkSession, path: str) -> bool:
    """Whether the last byte closes an object."""
    fs, at = file_system(spark, path)
    size = fs.getFileStatus(at).getLen()
    if not size:
        return False
    stream = fs.open(at)
    try:
        stream.seek(size - 1)
        return stream.read() == ord("}")
    finally:
        stream.close()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each piece, and the brackets that it leaves open if it begins outside of a string or within one."""
    left = lambda s: s.count("{") + s.count("[") - s.count("}") - s.count("]")
    for b in batches:
        cut = [_ESCAPED.sub("", x).split('"') for x in b.column("value").to_pylist()]
        found = ([len(x) - 1 for x in cut], [left("".join(x[::2])) for x in cut], [left("".join(x[1::2])) for x in cut])
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in found)], names=[*b.schema.names, "q", "out", "within"])


def _begins(text: str, depth: int) -> int:
    """Where the first object within two brackets begins; the text's length if there is none."""
    quoted = skip = False
    for at, c in enumerate(text):
        if quoted:
            quoted, skip = skip or c != '"', not skip and c == "\\"
        elif c == '"':
            quoted = True
        elif c == "{" and depth == 2:
            return at
        else:
            depth += (c in "[{") - (c in "]}")
    return len(text)


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line_no, value, around): an object of the array or null, and what stands before it but for one comma."""
    for b in batches:
        value, around = [], []
        for text, start, end in zip(b.column("text").to_pylist(), b.column("start").to_pylist(), b.column("end").to_pylist(), strict=True):
            at = _begins(text, start) if end == 2 else len(text)
            before = text[:at]
            if at < len(text) and start == 2:
                before = "" if before.strip(_SPACE) == "," else before + "!"  # no JSON, so it's refused
            value.append(text[at:] or None)
            around.append(before)
        yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(value, pa.string()), pa.array(around, pa.string())], names=["line_no", "value", "around"])


def document_parts(spark: SparkSession, path: str) -> tuple[object, DataFrame]:
    """(the document with its array empty, (line_no, value) of the array's objects, numbered in order with gaps).

    The file is read in splits, piece by piece up to each closing brace. Quotes, then brackets, then ends of objects are counted within each split
    and carried over from those before, as in csv_records, so no task gets more than a split or one object.
    """
    last = _ends_closed(spark, path)
    read = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    pieces = written(read.mapInArrow(_counts, "value string, f string, b long, i long, q long, out long, within long"), "json-pieces")
    final = pieces.agg(F.max(F.struct("b", "i")).alias("m")).first()["m"]
    if final is None:
        raise FormatError("invalid JSON: empty document")
    order = Window.partitionBy("f", "b").orderBy("i")
    here, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    quoted = (F.col("before") + F.coalesce(F.sum("q").over(earlier), F.lit(0))) % 2 == 1
    closed = F.lit(last) | (F.col("b") != final["b"]) | (F.col("i") != final["i"])
    at = pieces.join(F.broadcast(_carried(pieces, "q")), ["f", "b"]).withColumn("quoted", quoted).withColumn("free", (F.col("quoted").cast("long") + F.col("q")) % 2 == 0)
    delta = F.when(F.col("quoted"), F.col("within")).otherwise(F.col("out")) - (closed & F.col("free")).cast("long")
    at = written(at.select("f", "b", "i", F.when(closed, F.concat("value", F.lit("}"))).otherwise(F.col("value")).alias("value"), "free", delta.alias("delta")), "json-braces")
    at = at.join(F.broadcast(_carried(at, "delta")), ["f", "b"]).withColumn("end", F.col("before") + F.sum("delta").over(here)).drop("before")
    at = written(at.withColumn("ends", (F.col("free") & (F.col("end") <= 2)).cast("long")), "json-ends")
    nth = F.col("before") + F.coalesce(F.sum("ends").over(earlier), F.lit(0))
    groups = at.join(F.broadcast(_carried(at, "ends")), ["f", "b"]).withColumn("g", nth.cast("long")).groupBy("g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "i", "value"))), lambda x: x["value"]), "").alias("text"),
        F.min_by(F.col("end") - F.col("delta"), F.struct("b", "i")).alias("start"), F.max_by("end", F.struct("b", "i")).alias("end"),
    )
    parts = written(groups.mapInArrow(_parted, "line_no long, value string, around string"), "json-parts")
    around = parts.where("around <> ''").select("line_no", "around").orderBy("line_no").limit(_MOST_PARTS + 1).collect()
    if len(around) > _MOST_PARTS:
        raise FormatError("invalid JSON between the objects of an array")
    return strict_loads("".join(r["around"] for r in around)), parts.where("value is not null").select("line_no", "value")
