"""Candidate-set CSV: strict columns, typed parse, violations instead of silent nulls."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..operators.evidence_checks import raise_if_any
from ..operators.oracle import violations
from ..schemas import ORACLE_ROWS
from ..storage import written
from .strict_json import FormatError

_INT = r"^[+-]?\d(_?\d)*$"
_FLOAT = r"^[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?$"


def _carried(rows: DataFrame, column: str) -> DataFrame:
    """(f, b, before): what the column adds up to in the earlier splits of each split's file; one row a split."""
    earlier = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("f", "b").agg(F.sum(column).alias("t")).select("f", "b", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(f, record, text) of quoted CSV files, records counted from 1 in the order of the bytes; blank lines outside quotes are none.

    A file is read in splits, line by line. A line goes on with the record before it if the quotes so far are odd, as
    they are where quotes enclose whole fields and are doubled within. Quotes and records are counted within each split and carried over from
    those before, one row of totals each, so splits are tasks of their own; only lines of one record come together.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = written(lines.withColumn("q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))), "csv-lines")
    order = Window.partitionBy("f", "b").orderBy("i")
    quotes = F.col("before") + F.coalesce(F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lines.join(F.broadcast(_carried(lines, "q")), ["f", "b"]).withColumn("open", quotes % 2 == 1).where("open or value <> ''")
    at = written(at.select("f", "b", "i", "value", (~F.col("open")).cast("int").alias("starts")), "csv-starts")
    record = (F.col("before") + F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "i", "value"))), lambda x: x["value"]), "\n")
    return at.join(F.broadcast(_carried(at, "starts")), ["f", "b"]).withColumn("record", record).groupBy("f", "record").agg(text.alias("text"))


def read_oracle_csv(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Rows of a candidate-set CSV file.

    The header must name the nine required columns in any order, and may name fresh_score. Fields that
    don't parse are errors that tell the number of their record, the header being 1; a blank fresh_score is null.
    """
    records = written(csv_records(spark, path), "csv-records")
    heads = records.where("record = 1").limit(2).collect()
    if len(heads) != 1:
        raise FormatError("oracle CSV must be one file with a header")
    columns = next(csv.reader(io.StringIO(heads[0]["text"].lstrip("\ufeff"))))
    names = [f"c{i}" for i in range(len(columns))]
    parsed = F.from_csv(F.col("text"), ", ".join(f"{c} string" for c in names), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    # exploding one array makes it a column; otherwise a record would be parsed anew wherever one of its fields is named
    raw = records.where("record > 1").select("record", F.explode(F.array(parsed)).alias("r")).select("record", *[F.col(f"r.{c}").alias(c) for c in names])
    if len(set(columns)) == len(columns):
        raw = raw.toDF("record", *columns)
    names = columns
    wanted = [f.name for f in ORACLE_ROWS]
    wrong = set(names) ^ set(wanted)
    if len(set(names)) != len(names) or wrong - {"fresh_score"}:
        raise FormatError(f"oracle CSV has unexpected, repeated or missing columns: {sorted(wrong - {'fresh_score'}) or sorted(names)}")
    if "fresh_score" not in names:
        raw = raw.withColumn("fresh_score", F.lit(None).cast("string"))
    typed, bad = {}, []
    for f in ORACLE_ROWS:
        text = py_strip(F.col(f.name))
        kind = f.dataType.simpleString()
        if kind == "string":
            typed[f.name] = text
            bad.append(F.when(F.coalesce(text, F.lit("")) == "", f.name))
            continue
        value = F.when(text.rlike(_INT if kind == "int" else _FLOAT), F.expr(f"try_cast(replace(`{f.name}`, '_', '') as {kind})"))
        typed[f.name] = value
        failed = value.isNull() & ((F.coalesce(text, F.lit("")) != "") if f.name == "fresh_score" else F.lit(True))
        bad.append(F.when(failed, f.name))
    rows = raw.select("record", F.array_compact(F.array(*bad)).alias("_bad"), *[c.cast(ORACLE_ROWS[n].dataType).alias(n) for n, c in typed.items()])
    if check:
        rows = written(rows, "csv-rows")  # every check and the caller read it
        first = rows.where(F.size("_bad") > 0).orderBy("record").limit(5).collect()
        if first:
            raise FormatError("oracle CSV has invalid fields: " + "; ".join(f"record {r['record']}: {', '.join(r['_bad'])}" for r in first))
    rows = rows.drop("_bad", "record")
    if check:
        raise_if_any(violations(rows))
    return rows
