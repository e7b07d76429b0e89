"""Requests (JSON lines) and plan bundles (one JSON document)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import has_duplicates, normalize_signatures
from ..operators.evidence_checks import duplicates, is_blank, raise_if_any
from ..policies import PlanApplication, QueryBudget
from ..schemas import PLANS, REQUESTS
from ..storage import written
from .strict_json import FormatError, check_shape, checked, problems, refuse_problems

_REQUEST = {"target_query_id": str, "target_query": str, "signatures": [str], "signature_extractor_id": str, "signature_extractor_version": str, "signature_input_scope": str}
#: Line ends other than \n and \r that end a line of the format too.
_OTHER_ENDS = "[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests, one JSON object a line. An empty file has none; blank lines and repeated ids are errors."""
    lines = checked(spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value"), lambda x: check_shape(x, _REQUEST))
    broken = (F.trim("value") == "") | F.col("value").rlike(_OTHER_ENDS)
    # the file is read and parsed once; every check looks at the written rows
    lines = written(lines.select("line_no", F.when(broken, "blank_or_broken_line").alias("broken"), "problem", F.from_json("value", REQUESTS).alias("r")), "requests")
    raise_if_any(lines.where("broken is not null").select(F.col("broken").alias("rule"), F.col("line_no").cast("string").alias("key")))
    refuse_problems(lines.where("problem is not null").select("line_no", "problem"), "requests")
    rows = lines.select("r.*").withColumn("signatures", normalize_signatures(F.col("signatures")))
    raise_if_any(request_violations(rows))
    return rows


def request_violations(rows: DataFrame) -> DataFrame:
    c = F.col
    blank = [F.when(is_blank(c(x)), F.lit(f"blank_{x}")) for x in ("target_query_id", "target_query", "signature_extractor_id", "signature_extractor_version")]
    rules = [*blank, F.when(c("signature_input_scope") != "query_only", "signature_input_scope"), F.when(has_duplicates(c("signatures")), "duplicate_signatures")]
    own = rows.select(F.explode(F.array_compact(F.array(*rules))).alias("rule"), c("target_query_id").alias("key"))
    protocol = rows.select("signature_extractor_id", "signature_extractor_version", "signature_input_scope").distinct().agg(F.count("*").alias("n")).where("n > 1").select(F.lit("several_signature_protocols"), F.lit("*"))
    return own.union(duplicates(rows, "target_query_id")).union(protocol)


@dataclass
class PlanBundle:
    plans: DataFrame
    applier_id: str
    application_version: str

    def application(self, budget: QueryBudget) -> PlanApplication:
        """The plans as applied under a budget: its limits are what each plan asks for."""
        return PlanApplication(self.applier_id, self.application_version, budget.max_retrieval_queries, budget.max_top_k, budget.max_context_tokens)


def _check_bundle(doc) -> None:
    plan = {"target_query_id": str, "experience_id": str, "transformed_query": str}
    check_shape(doc, {"schema_version": int, "applier_id": str, "application_version": str, "plans": [plan]})
    if doc["schema_version"] != 1:
        raise FormatError("unsupported schema_version")
    if not doc["applier_id"].strip() or not doc["application_version"].strip():
        raise FormatError("applier identity must not be blank")


def read_plan_bundle(spark: SparkSession, path: str) -> PlanBundle:
    text = spark.read.option("wholetext", True).text(path).select(F.lit(1).alias("line_no"), "value")
    refuse_problems(problems(text, _check_bundle), "plan bundle")
    kind = T.StructType([T.StructField("applier_id", T.StringType()), T.StructField("application_version", T.StringType()), T.StructField("plans", T.ArrayType(PLANS))])
    doc = text.select(F.from_json("value", kind).alias("d"))
    head = doc.select("d.applier_id", "d.application_version").first()
    plans = doc.select(F.explode("d.plans").alias("p")).select("p.*")
    blank = plans.select(F.explode(F.array_compact(F.array(*[F.when(is_blank(F.col(x)), F.lit(f"blank_{x}")) for x in ("target_query_id", "experience_id", "transformed_query")]))).alias("rule"), F.concat_ws("/", "target_query_id", "experience_id").alias("key"))
    raise_if_any(blank.union(duplicates(plans, "target_query_id", "experience_id")))
    return PlanBundle(plans, head["applier_id"], head["application_version"])
