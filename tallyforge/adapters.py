"""Logical relations derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Scores are eighths, so sums are exact in any order. {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import ENVIRONMENT_FIELDS
from .storage import file_system

RELATIONS = {
    "oracle_rows": """
        SELECT cast(l_orderkey AS string) AS target_query_id, cast(l_suppkey AS string) AS experience_id, 'snapshot-1' AS memory_snapshot_id,
          cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS int) AS candidate_rank, (o_custkey % 9) / 8e0 AS direct_score,
          (cast(round(max(l_discount) * 100) AS int) % 9) / 8e0 AS reuse_score, 1 AS retrieval_query_count, 5 AS requested_top_k, 2048 AS context_token_budget,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 9) / 8e0 END AS fresh_score
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_suppkey, o_custkey, o_orderkey""",
    "raw_oracle_rows": """
        SELECT cast(l_orderkey AS string) AS target_query_id, cast(l_suppkey AS string) AS experience_id, 'snapshot-' || cast(CASE WHEN l_orderkey % 997 = 0 THEN 2 ELSE 1 END AS string) AS memory_snapshot_id,
          l_linenumber AS candidate_rank, (o_custkey % 9 + CASE WHEN l_suppkey % 17 = 0 THEN 1 ELSE 0 END) / 8e0 AS direct_score, (l_partkey % 9) / 8e0 AS reuse_score,
          1 AS retrieval_query_count, CASE WHEN l_suppkey % 19 = 0 THEN 0 ELSE 5 END AS requested_top_k, 2048 AS context_token_budget,
          CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE (o_orderkey % 9) / 8e0 END AS fresh_score
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "planted_oracle_rows": """
        SELECT CASE WHEN k = 0 THEN '  ' ELSE cast(l_orderkey AS string) END AS target_query_id, CASE WHEN k <> 1 THEN cast(l_suppkey AS string) END AS experience_id, CASE WHEN k = 2 THEN '' ELSE 'snapshot-1' END AS memory_snapshot_id,
          CASE WHEN k = 3 THEN 0 WHEN k = 4 AND l_linenumber = 2 THEN 1 ELSE l_linenumber END AS candidate_rank, CASE WHEN k = 5 THEN -0.125e0 WHEN k <> 6 THEN (o_custkey % 9) / 8e0 END AS direct_score,
          CASE WHEN k = 7 THEN 1.25e0 WHEN k <> 8 THEN (l_partkey % 9) / 8e0 END AS reuse_score, CASE WHEN k = 9 THEN 0 WHEN k <> 10 THEN 1 END AS retrieval_query_count, CASE WHEN k = 11 THEN -5 WHEN k = 12 AND l_linenumber > 1 THEN 6 ELSE 5 END AS requested_top_k,
          CASE WHEN k = 13 THEN 0 WHEN k = 14 AND l_linenumber > 1 THEN 1024 ELSE 2048 END AS context_token_budget, CASE WHEN k = 15 THEN -1e0 WHEN k = 16 AND l_linenumber > 1 THEN NULL WHEN k = 17 THEN NULL ELSE (o_orderkey % 9) / 8e0 END AS fresh_score
        FROM (SELECT *, l_orderkey % 41 AS k FROM {lineitem}) JOIN {orders} ON l_orderkey = o_orderkey""",
    "observations": """
        SELECT cast(o_custkey AS string) AS experience_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS int) AS seq, 't' || cast(o_orderkey % 4000 AS string) AS target_query_id,
          'g' || cast(o_orderkey % 7000 AS string) AS target_group_id, (o_orderkey % 9) / 8e0 AS direct_score, (cast(floor(o_totalprice) AS bigint) % 9) / 8e0 AS reuse_score, 0.5e0 AS good_threshold,
          'ds' || cast(o_orderkey % 3 AS string) AS dataset_id, CASE WHEN o_orderkey % 31 = 0 THEN 'test' ELSE 'calibration' END AS evidence_role, CASE WHEN o_orderkey % 29 = 0 THEN 'other' ELSE 'f1' END AS metric_protocol_id,
          'plan' AS applier_id, CASE WHEN o_orderkey % 37 = 0 THEN 'v2' ELSE 'v1' END AS applier_version
        FROM {orders}""",
    "sources": """
        SELECT cast(c_custkey AS string) AS experience_id, CASE WHEN c_custkey % 41 = 0 THEN 'retired' ELSE 'candidate' END AS state, 't' || cast(c_custkey % 4000 AS string) AS source_query_id, (c_custkey % 9) / 8e0 AS direct_score,
          (c_nationkey % 9) / 8e0 AS reuse_score, 0e0 AS minimum_gain, 'ds' || cast(c_custkey % 3 AS string) AS source_dataset_id, 'g' || cast(c_custkey % 7000 AS string) AS source_group_id, 'dev' AS source_split,
          CASE WHEN c_custkey % 5 = 0 THEN 'UNSET' WHEN c_custkey % 6 = 0 THEN 'elsewhere' ELSE 'ds' || cast(c_custkey % 3 AS string) END AS stored_dataset_id, 'dev' AS stored_split, 'unknown' AS stored_group_id,
          CASE WHEN c_custkey % 43 = 0 THEN 'test' ELSE 'development' END AS evidence_role, 'f1' AS source_metric_protocol_id, 'plan' AS source_applier_id, 'v1' AS source_applier_version
        FROM {customer} WHERE c_custkey % 47 <> 0""",
    "activities": """
        SELECT cast(user_id AS string) AS experience_id, max(CASE WHEN event_type = 'purchase' THEN extract(day FROM ts) - 1 END) AS last_validated_step,
          max(CASE WHEN event_type = 'view' THEN extract(day FROM ts) END) AS last_used_step
        FROM {events} GROUP BY user_id""",
    "tier_records": """
        SELECT cast(c_custkey AS string) AS experience_id, CASE WHEN c_custkey % 5 = 0 THEN 'candidate' ELSE 'active' END AS state FROM {customer} WHERE c_custkey % 13 <> 0""",
    "stored_tiers": """
        SELECT cast(k AS string) AS experience_id, CASE k % 7 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' WHEN 2 THEN 'expired' ELSE 'cold' END AS tier, CASE WHEN k % 7 = 0 AND k % 2 = 1 THEN k WHEN k % 21 = 3 THEN 2 END AS hot_rank FROM (SELECT c_custkey AS k FROM {customer}) WHERE k % 5 <> 0
        UNION ALL SELECT cast(c_custkey AS string), 'cold', NULL FROM {customer} WHERE c_custkey % 11 = 0""",
    "plans": """
        SELECT 'd' || cast(doc_id AS string) AS target_query_id, 'b' || cast(doc_id % 7 AS string) AS experience_id, 'plan "' || cast(doc_id AS string) || '"; é' AS transformed_query FROM {documents}""",
    "environments": """
        SELECT cast(c_custkey AS string) AS experience_id, CASE c_custkey % 13 WHEN 0 THEN ' Unknown ' WHEN 1 THEN 'other' ELSE 'wiki' END AS corpus_id, 'v' || cast(c_custkey % 7 % 2 AS string) AS corpus_version, 'bm25' AS retriever_id,
          'r' || cast(c_custkey % 3 AS string) AS retriever_version, 'rw' AS rewriter_id, 'rw' || cast(c_custkey % 5 AS string) AS rewriter_version, CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'ix' END AS index_id,
          'x' || cast(c_custkey % 11 % 2 AS string) AS index_version, CASE WHEN c_custkey % 19 = 0 THEN 'unset' ELSE 'words' END AS analyzer_id, 'a' || cast(c_custkey % 4 % 2 AS string) AS analyzer_version
        FROM {customer}""",
    "signatures": """
        SELECT a.p_partkey AS id, a.p_name || '|' || replace(a.p_name, ' ', '|') AS required, replace(b.p_name, ' ', '|') || '|' || a.p_type AS observed, CASE WHEN a.p_partkey % 4 = 0 THEN a.p_type WHEN a.p_partkey % 4 = 1 THEN b.p_type ELSE '' END AS contra
        FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1""",
    "requests": """
        SELECT 'd' || cast(doc_id AS string) AS target_query_id, text AS target_query, 's' || cast(doc_id % 4 AS string) || '|s' || cast(doc_id % 5 + 1 AS string) AS signatures FROM {documents}""",
    "memory": """
        SELECT 'b' || cast(item_id AS string) AS experience_id, item_id, CASE item_id % 9 WHEN 0 THEN 'quarantine' WHEN 1 THEN 'candidate' ELSE 'active' END AS state, 'd' || cast(item_id * 7 % 100 AS string) AS source_query_id,
          text AS source_query, CASE WHEN item_id % 11 = 0 THEN 'unset' ELSE 'log' END AS provenance, 's' || cast(item_id % 4 AS string) || '|s' || cast(item_id % 6 + 2 AS string) AS required,
          CASE WHEN item_id % 5 = 0 THEN 's' || cast(item_id % 3 AS string) ELSE '' END AS contra, CASE WHEN item_id % 8 = 7 THEN 'other' ELSE 'wiki' END AS corpus_id
        FROM {benchmark}""",
    "memory_observations": """
        SELECT 'b' || cast(o_orderkey % n AS string) AS experience_id, (o_custkey % 9) / 8e0 AS direct_score, ((o_custkey + o_orderkey % 5 + o_orderkey % n % 3) % 9) / 8e0 AS reuse_score, 0.5e0 AS good_threshold
        FROM {orders} CROSS JOIN (SELECT max(item_id) + 1 AS n FROM {benchmark})""",
    "memory_activities": """
        SELECT 'b' || cast(user_id % n AS string) AS experience_id, max(CASE WHEN event_type = 'purchase' THEN extract(day FROM ts) - 1 END) AS last_validated_step, max(CASE WHEN event_type = 'view' THEN extract(day FROM ts) END) AS last_used_step
        FROM {events} CROSS JOIN (SELECT max(item_id) + 1 AS n FROM {benchmark}) GROUP BY user_id % n""",
    "turns": """
        SELECT cast(conv_id AS string) AS episode_id, cast(turn AS int) AS turn_index, 'u' || cast(CASE WHEN conv_id % 23 = 0 THEN 0 ELSE turn END AS string) AS turn_id,
          CASE WHEN turn = 0 AND conv_id % 11 <> 0 THEN 'base' WHEN conv_id % 13 = 0 AND turn = 2 THEN 'base' WHEN turn % 2 = 1 THEN 'reuse_repair' ELSE 'fresh_repair' END AS action,
          CASE WHEN turn % 2 = 1 AND conv_id % 7 <> 0 THEN 'card@1' END AS experience_card_version, CASE WHEN turn = 0 THEN '' WHEN conv_id % 5 = 0 THEN 'g0' ELSE 'g' || cast(turn - 1 AS string) END AS targets,
          'g' || cast(turn AS string) AS gaps, CASE WHEN conv_id % 17 = 0 THEN 'sufficient' ELSE 'insufficient' END AS sufficiency,
          CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN CASE WHEN conv_id % 3 = 0 THEN 'answer' ELSE 'stop_abstain' END WHEN turn % 2 = 0 THEN 'reuse_repair' ELSE 'fresh_repair' END AS next_action,
          CASE WHEN conv_id % 19 = 0 THEN '' ELSE role END AS operator, cast(length(text) AS int) AS n_text
        FROM {conversations}""",
    "episodes": """
        SELECT cast(conv_id AS string) AS episode_id, 'rc' || cast(conv_id % 3 AS string) AS run_context_id, 'cg' || cast(conv_id % 4 AS string) AS comparison_group_id, 'q' || cast(conv_id % 2 AS string) AS original_query,
          CASE WHEN conv_id % 3 = 0 THEN 'sufficient' WHEN conv_id % 10 = 1 THEN 'baseline_complete' ELSE 'budget' END AS terminal_reason, CASE WHEN conv_id % 6 < 4 THEN 's' || cast(conv_id % 6 AS string) END AS document_session_id
        FROM {conversations} GROUP BY conv_id""",
    "events": """
        SELECT 'v' || cast(o_orderkey AS string) AS verification_id, cast(o_custkey % 150 AS string) AS episode_id, CASE WHEN o_orderkey % 10 = 0 THEN 'answer' ELSE 'paired_benefit' END AS target, CASE o_orderkey % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'human' WHEN 2 THEN 'judge' ELSE 'proxy' END AS source,
          CASE o_orderkey % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'uncertain' END AS verdict, CASE WHEN o_orderkey % 12 <> 0 THEN cast(o_custkey % 149 AS string) END AS direct_baseline_episode_ref,
          CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE (o_custkey % 9) / 8e0 END AS baseline_score, (o_orderkey % 9) / 8e0 AS treatment_score, 0.5e0 AS quality_threshold,
          (o_orderkey % 9) / 8e0 - (o_custkey % 9) / 8e0 + CASE WHEN o_orderkey % 16 = 0 THEN 0.25e0 ELSE 0e0 END AS score
        FROM {orders}""",
    "cards": """
        SELECT 'c' || cast(s_suppkey AS string) AS card_id, '1' AS version, CASE s_suppkey % 3 WHEN 0 THEN 'active' ELSE 'candidate' END AS lifecycle_state, CASE s_suppkey % 4 WHEN 0 THEN 'gold' WHEN 1 THEN 'human' WHEN 2 THEN 'multi_judge' ELSE 'proxy' END AS verification_tier,
          4 AS matched_trials, s_suppkey % 5 AS benefit_count, s_suppkey % 3 AS neutral_count, 4 - s_suppkey % 5 - s_suppkey % 3 AS harm_count, s_suppkey % 4 AS direct_correct_trials, (s_suppkey % 9 - 4) / 8e0 AS mean_gain,
          s_suppkey % 4 AS independent_episode_count, s_suppkey % 3 AS independent_document_count, 'v' || cast(s_suppkey AS string) || '|v' || cast(s_suppkey + 1 AS string) || '|v' || cast(s_suppkey * 2 AS string) || '|v' || cast(s_suppkey * 3 + 5 AS string) AS event_ids
        FROM {supplier}""",
}


def sql_of(name: str, mark=lambda t: t) -> str:
    """SQL of a relation with mark(table) for each table."""
    return re.sub(r"\{(\w+)\}", lambda m: mark(m[1]), RELATIONS[name]).strip()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts that lie in fewer splits than there are cores are dealt over the cores, as their words take time."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


#: Input bytes for each partition of a shuffle, most bytes that a task reads of a shuffle, and of a file: what a task
#: sorts and groups in memory is bounded by these, however large the tables are.
PARTITION_BYTES, TASK_BYTES, SPLIT_BYTES = 4 << 20, 8 << 20, 32 << 20


def fit_shuffles(spark: SparkSession, size: int) -> None:
    """Sets the session's shuffles up for an input of so many bytes. Settings that are finer already stay."""
    conf, of = spark.conf, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    partitions = -(-size // PARTITION_BYTES)
    if partitions > int(conf.get("spark.sql.shuffle.partitions")):
        conf.set("spark.sql.shuffle.partitions", str(partitions))
    for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
        if of(conf.get(key)) > most:
            conf.set(key, str(most))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame over the tables in sf_dir."""
    tables = sorted(set(re.findall(r"\{(\w+)\}", RELATIONS[name])))
    files = [file_system(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables]
    fit_shuffles(spark, sum(fs.getContentSummary(at).getLength() for fs, at in files))
    return spark.sql(RELATIONS[name], **{t: load(spark, sf_dir, t) for t in tables})


def parts(col: str):
    """Array of the non-empty parts of a column separated by bars."""
    return F.array_remove(F.split(col, r"\|"), "")


def environment_struct():
    return F.struct(*[F.col(f) for f in ENVIRONMENT_FIELDS])


#: The environment that records are compared with.
CURRENT = {
    "corpus_id": "wiki", "corpus_version": "v0", "retriever_id": "bm25", "retriever_version": "r1", "rewriter_id": "rw", "rewriter_version": "rw1", "index_id": "ix", "index_version": "x0", "analyzer_id": "words", "analyzer_version": "a0",
}
