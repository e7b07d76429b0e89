"""Strict JSON as columns: duplicate keys, non-finite numbers, unknown or missing keys and wrong kinds are errors."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FormatError(ValueError):
    """Raised for a file that breaks its format."""


def strict_loads(text: str):
    def unique(pairs):
        seen = {}
        for k, v in pairs:
            if k in seen:
                raise FormatError(f"duplicate key {k!r}")
            seen[k] = v
        return seen

    def refuse(name):
        raise FormatError(f"non-finite number {name}")

    try:
        return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
    except json.JSONDecodeError as e:
        raise FormatError(f"invalid JSON: {e.msg}") from None


#: Kinds that a shape may ask for: str, int, float (ints too), bool, [kind] for lists, dict for objects, (kind, None) for nullable.
def check_shape(value, shape, where: str = "$") -> None:
    """Exact keys and kinds, at every depth; booleans are no numbers."""
    if isinstance(shape, tuple):
        if value is not None:
            check_shape(value, shape[0], where)
    elif isinstance(shape, dict):
        if not isinstance(value, dict):
            raise FormatError(f"{where} must be an object")
        if wrong := set(value) ^ set(shape):
            raise FormatError(f"{where} has unknown or missing keys {sorted(wrong)}")
        for k, s in shape.items():
            check_shape(value[k], s, f"{where}.{k}")
    elif isinstance(shape, list):
        if not isinstance(value, list):
            raise FormatError(f"{where} must be a list")
        for i, x in enumerate(value):
            check_shape(x, shape[0], f"{where}[{i}]")
    else:
        ok = isinstance(value, (int, float) if shape is float else shape) and (shape is bool or not isinstance(value, bool))
        if not ok or (shape is float and abs(value) == float("inf")):
            raise FormatError(f"{where} must be {shape.__name__}")


def checked(lines: DataFrame, check: Callable[[object], None]) -> DataFrame:
    """Rows (line_no, value) with `problem`: why the text fails the check, or null. Runs where the text is."""

    @F.pandas_udf("string")
    def why(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            try:
                check(strict_loads(text or ""))
            except FormatError as e:
                return str(e)

        for s in values:
            yield pd.Series([one(t) for t in s], dtype=object)

    return lines.select(F.col("line_no").cast("long").alias("line_no"), "value", why("value").alias("problem"))


def problems(lines: DataFrame, check: Callable[[object], None]) -> DataFrame:
    """(line_no, problem) of the rows that fail."""
    return checked(lines, check).where("problem is not null").select("line_no", "problem")


def refuse_problems(found: DataFrame, what: str) -> None:
    if rows := found.orderBy("line_no").limit(10).collect():
        raise FormatError(f"{what}: " + "; ".join(f"{r['line_no']}: {r['problem']}" for r in rows))
