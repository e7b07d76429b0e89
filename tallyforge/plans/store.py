"""Tables that grow by batches: Parquet folders by batch and by bucket of a key, so an append reads only the buckets that it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evidence_checks import duplicates, raise_if_any
from ..storage import file_system

BUCKETS = 64


class KeyedTable:
    """Rows with a key in path/batch=<n>/bucket=<b>. The buckets of a batch are known before anything is read.

    A batch that comes again replaces itself, as after a failure; a key that comes again in another batch is refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), tuple(key), buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: as many numbers as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are listed for the scan; with batch and bucket."""
        full = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        fs, at = file_system(self.spark, self.path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(self.path)
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))

    def repeated(self, rows: DataFrame, batch: int) -> DataFrame:
        """(rule, key) of keys that rows hold twice or that another batch holds."""
        name = F.concat_ws("/", *self.key).alias("key")
        there = self.read(self.touched(rows)).where(F.col("batch") != batch).select(*self.key)
        again = rows.select(*self.key).join(there, list(self.key), "left_semi").select(F.lit("committed_before").alias("rule"), name)
        return duplicates(rows, *self.key).union(again)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch, in place of what it wrote before. A bucket's rows come together, those of a large one in several files."""
        cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        out = rows.select(*cols, self.bucket().alias("bucket"))
        out.repartitionByRange("bucket", *self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")

    def commit(self, rows: DataFrame, batch: int, check=None) -> None:
        """Append once check(rows) and the keys' index find nothing against it."""
        if check is not None:
            raise_if_any(check(rows))
        raise_if_any(self.repeated(rows, batch))
        self.append(rows, batch)
