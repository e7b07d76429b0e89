"""Shared pieces: tables written to the cluster's shared folder, connected components, label sampling."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of this machine's only where the setting is absent and all runs here (tests).

    On a cluster executors would each write to their own disk and results would lack rows, so that's an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[(\d+|\*)(,\s*\d+)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables materialized inside when it ends, but for those to keep."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for p in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    Within scratch(), the table goes with it unless it is to be kept for a result that is still to be read.
    All others go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _scratch.get()) is not None and not keep:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    if path not in (paths or ()):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of an Arrow batch that carries whole texts; the default of 10,000 can be gigabytes of long ones.
TEXT_ROWS = 512


def with_text(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to TEXT_ROWS rows from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A table that lies in fewer splits than there are cores, dealt over the cores; any other where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph given as edges(u, v) of longs, u <> v: returns (node, root).

    Each round hooks every node to its neighbour of least priority (a hash of the id, so that
    chains shrink geometrically in expectation) and contracts the graph; the hooks of all rounds
    are then composed. root identifies the component; it is some member, not the smallest.
    Nodes without an edge aren't listed. All rounds are joins on tables that shrink; each is
    written to the shared folder.
    """
    cur = materialize(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "cc-edges",
    )
    hooks: list[DataFrame] = []
    for _ in range(max_rounds):
        if cur.isEmpty():
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        prio = lambda c: F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("n"))
        best = both.groupBy("u").agg(F.min(prio("v")).alias("b"))
        hook = materialize(best.select(F.col("u").alias("node"), F.least("b", prio("u"))["n"].alias("root")), "cc-hook")
        hooks.append(hook)
        left = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        nxt = cur.join(left, "u").join(right, "v").where("ru <> rv")
        cur = materialize(nxt.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "cc-edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not hooks:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
    out = hooks[0]
    for h in hooks[1:]:
        step = h.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out


def held_out(modulus: int, remainder: int):
    """True where crc32 of the decimal doc_id leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, limit: int, value: int | None = None) -> DataFrame:
    """(doc_id, text, y): at most `limit` labelled documents, those of least hash of doc_id.

    The bound is a documented parameter of each trained operator, so a fit needs the same memory at
    every size of the corpus. A document with several labels takes the least one, a doc_id with several rows the
    least text; value keeps documents of that label only; rows without id, text or label aren't used.
    """
    ids = (
        labels.where(keep).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).alias("y")).where(F.lit(True) if value is None else F.col("y") == value)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
