"""Sinks: datasets by Spark's committer, single files by an atomic rename."""

from __future__ import annotations

import json
import os
import tempfile
import textwrap
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.oracle import HINDSIGHT
from ..storage import file_system, shared_dir


def write_atomic(path: str, text: str | Iterable[str]) -> None:
    """Write a single file beside its target, in one or several texts as they come, flush it to disk, then rename."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=folder, prefix=".writing-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.writelines([text] if isinstance(text, str) else text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def write_joined(rows: DataFrame, path: str, order: list[str], between: str, head: str = "", tail: str = "") -> None:
    """One file of head, the texts of column `value` in order with `between` them, and tail.

    Tasks sort and write ranges of rows as part files; the file system's streams put these together, byte by byte, beside the target, which
    they then replace. Rows never come to the driver.
    """
    spark = rows.sparkSession
    jvm = spark._jvm
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    rows.orderBy(*order).select("value").write.option("lineSep", between).text(folder)
    fs, at = file_system(spark, folder)
    try:
        found = sorted((f.getPath().getName(), f) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-") and f.getLen())

        def fill(out) -> None:
            out.write(bytearray((head if found else head.rstrip("\n")).encode()))
            for i, (_, f) in enumerate(found):
                after = len(between.encode()) if i == len(found) - 1 else 0  # nothing follows the last text
                stream = fs.open(f.getPath())
                try:
                    jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, f.getLen() - after)
                finally:
                    stream.close()
            out.write(bytearray((tail if found else tail.lstrip("\n ")).encode()))

        _replace(spark, path, fill)
    finally:
        fs.delete(at, True)


def _replace(spark: SparkSession, path: str, fill) -> None:
    """Let fill(stream) write a file beside the target, then rename it. Paths without a scheme are this machine's, as for write_atomic."""
    if "://" not in path:
        target = os.path.abspath(path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        temp = os.path.join(os.path.dirname(target), f".writing-{uuid.uuid4().hex}")
        try:
            out = spark._jvm.java.io.FileOutputStream(temp)
            try:
                fill(out)
                out.getFD().sync()
            finally:
                out.close()
            os.replace(temp, target)
        finally:
            if os.path.exists(temp):
                os.unlink(temp)
        return
    fs, target = file_system(spark, path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".writing-{uuid.uuid4().hex}")
    try:
        out = fs.create(temp)
        try:
            fill(out)
            out.hsync()
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(temp, target):
            raise OSError(f"can't replace {path}")
    finally:
        fs.delete(temp, False)


def json_lines(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One compact JSON object a line, in a folder of part files; ordered across files if asked."""
    (df.orderBy(*order) if order else df).select(json_lines(df).alias("value")).write.mode("overwrite").text(path)


def write_jsonl_file(df: DataFrame, path: str, order: list[str], leave: Sequence[str] = ()) -> None:
    """A single file of one object a line, in order; columns to leave are for the order only."""
    write_joined(df.select(*order, json_lines(df.drop(*leave)).alias("value")), path, order, "\n", tail="\n")


def oracle_report(summary: DataFrame, targets: DataFrame, path: str, source: str) -> None:
    """Report of the offline oracle: totals and targets, marked as a diagnostic; never the winner of a target."""
    if leaked := set(targets.columns) & set(HINDSIGHT):
        raise ValueError(f"report rows must not tell {sorted(leaked)}")
    top = summary.first()
    doc = {"offline_diagnostic_only": True, "source_csv": source, **(top.asDict() if top else {})}
    dumped = lambda x: json.dumps(x, ensure_ascii=False, indent=2, allow_nan=False)
    names = targets.columns

    def run(batches):
        for b in batches:
            text = [textwrap.indent(dumped({c: r[c] for c in names}), "    ") for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("target_query_id"), pa.array(text, pa.string())], names=["target_query_id", "value"])

    rows = targets.mapInArrow(run, "target_query_id string, value string")
    write_joined(rows, path, ["target_query_id"], ",\n", head=dumped(doc)[:-2] + ',\n  "targets": [\n', tail="\n  ]\n}\n")
