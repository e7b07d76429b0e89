import pytest

import __spark_entry__
from tallyforge import oracle_sql, queries
from tallyforge.streaming.evidence import lifecycle_stream

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df, cols):
    df = df[cols].copy()
    for c in cols:
        if df[c].dtype.kind == "f":
            df[c] = df[c].astype(float) + 0.0
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    a, b = queries.QUERIES[name](spark, sf).toPandas(), db.sql(oracle_sql.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a, sorted(a.columns)) == rows(b, sorted(a.columns))


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.QUERIES) <= set(__spark_entry__.oracle_sql())


def test_plans_push_down_and_prune(spark, sf):
    plan = queries.QUERIES["paired_outcomes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in plan and "o_orderpriority" not in plan
    top = queries.QUERIES["recall_topm"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top and "CartesianProduct" not in top


def test_stream_equals_batch(spark, tmp_path):
    from tallyforge.operators.reliability import lifecycle_state

    from .model import histories

    by = histories(30, 9)
    rows_ = [(e, i, d, r, 0.5) for e, h in by.items() for i, (d, r) in enumerate(h)]
    schema = "experience_id string, seq int, direct_score double, reuse_score double, good_threshold double"
    for part, keep in enumerate((lambda s: s < 4, lambda s: s >= 4)):
        spark.createDataFrame([r for r in rows_ if keep(r[1])], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = lifecycle_stream(src).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.experience_id: r.state for r in spark.sql("SELECT experience_id, max_by(state, observations) AS state FROM states GROUP BY experience_id").collect()}
    want = {r.experience_id: r.state for r in lifecycle_state(spark.createDataFrame(rows_, schema)).collect()}
    assert got == want


def test_shuffles_fit_the_input(spark, sf):
    """A task's share of a shuffle is bounded: partitions grow with the input, finer settings stay."""
    from tallyforge import adapters

    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    old = {k: spark.conf.get(k) for k in keys}
    small = adapters.PARTITION_BYTES
    try:
        spark.conf.set(keys[1], "64m")
        adapters.PARTITION_BYTES = 4096
        adapters.relation(spark, sf, "oracle_rows")
        n = int(spark.conf.get(keys[0]))
        assert n > 20 and spark.conf.get(keys[1]) == str(adapters.TASK_BYTES)
        adapters.relation(spark, sf, "tier_records")
        assert int(spark.conf.get(keys[0])) == n
        spark.conf.set(keys[1], "1m")
        adapters.fit_shuffles(spark, 1)
        assert spark.conf.get(keys[1]) == "1m"
    finally:
        adapters.PARTITION_BYTES = small
        for k, v in old.items():
            spark.conf.set(k, v)
