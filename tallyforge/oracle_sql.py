"""DuckDB SQL with the same rows as the registered queries."""

from __future__ import annotations

from .adapters import CURRENT, sql_of
from .functions.text import fold_table
from .queries import BUDGET, GATE, HOT, LIFECYCLE, POINTS, PORTFOLIO, TIERED
from .schemas import HARD_FIELDS, RETRIEVAL_FIELDS, SOFT_FIELDS

SQL: dict[str, str] = {}


def _with(*names: str) -> str:
    """CTEs of relations, named after them."""
    return "WITH " + ",\n".join(f"{n}_ AS ({sql_of(n)})" for n in names)


def outcome(d: str = "direct_score", r: str = "reuse_score", t: str = "good_threshold") -> str:
    return f"CASE WHEN {d} >= {t} AND {r} < {t} THEN 'direct_good_reuse_bad' WHEN {d} < {t} AND {r} >= {t} THEN 'direct_bad_reuse_good' WHEN {d} >= {t} THEN 'direct_good_reuse_good' ELSE 'direct_bad_reuse_bad' END"


def wilson(k: str, n: str) -> str:
    z = "1.959963984540054e0"
    p = f"({k} / {n}::double)"
    return f"CASE WHEN {n} = 0 THEN 1e0 ELSE least(1e0, ({p} + {z} * {z} / (2e0 * {n}) + {z} * sqrt({p} * (1e0 - {p}) / {n} + {z} * {z} / (4e0 * {n} * {n}))) / (1e0 + {z} * {z} / {n})) END"


def div(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0)::double, 0e0)"


def rules(source: str, key: str, named: list[tuple[str, str]]) -> str:
    """One SELECT per rule: its name and the key of every row where it holds."""
    return "\nUNION ALL ".join(f"SELECT '{n}' AS rule, {key} AS key FROM {source} WHERE {c}" for c, n in named)


def counted(*parts: str) -> str:
    return "SELECT rule, key, count(*) AS n FROM (" + "\nUNION ALL ".join(parts) + ") GROUP BY rule, key"


SQL["paired_outcomes"] = f"{_with('observations')} SELECT target_query_id, experience_id, seq::bigint AS seq, {outcome()} AS outcome, reuse_score - direct_score AS difference FROM observations_"

_TARGETS = f"""{_with("oracle_rows")}, t AS (
  SELECT target_query_id, min(memory_snapshot_id) AS memory_snapshot_id, count(*) AS candidate_count, string_agg(cast(candidate_rank AS varchar), '|' ORDER BY candidate_rank) AS candidate_ranks_evaluated,
    1::bigint AS retrieval_query_count, 5::bigint AS requested_top_k, 2048::bigint AS context_token_budget, min(direct_score) AS direct_score, max(reuse_score) AS candidate_set_oracle_reuse_score, max(fresh_score) AS fresh_score,
    count(*) FILTER (direct_score >= 0.5e0 AND reuse_score < 0.5e0) AS harms
  FROM oracle_rows_ GROUP BY target_query_id
), b AS (SELECT *, greatest(direct_score, candidate_set_oracle_reuse_score, fresh_score) AS offline_policy_oracle_score FROM t)"""
SQL["oracle_targets"] = (
    _TARGETS + " SELECT * EXCLUDE (harms), candidate_set_oracle_reuse_score - direct_score AS reuse_gain_over_direct, offline_policy_oracle_score - direct_score AS policy_gain_over_direct, offline_policy_oracle_score - candidate_set_oracle_reuse_score AS policy_gain_over_reuse FROM b"
)
SQL["oracle_summary"] = (
    _TARGETS
    + """, s AS (SELECT min(memory_snapshot_id) AS memory_snapshot_id, 0.5e0 AS good_threshold, count(*) AS target_count, sum(candidate_count)::bigint AS candidate_count, sum(harms)::bigint AS pair_harm_count,
    count(*) FILTER (candidate_set_oracle_reuse_score > direct_score) AS helpful_target_count, count(*) FILTER (candidate_set_oracle_reuse_score < direct_score) AS harmful_target_count,
    count(*) FILTER (direct_score >= 0.5e0 AND candidate_set_oracle_reuse_score < 0.5e0) AS candidate_set_reuse_target_harm_count, avg(direct_score) AS dm, avg(candidate_set_oracle_reuse_score) AS rm, avg(offline_policy_oracle_score) AS pm,
    count(*) FILTER (direct_score = offline_policy_oracle_score) AS action_direct, count(*) FILTER (direct_score < offline_policy_oracle_score AND candidate_set_oracle_reuse_score = offline_policy_oracle_score) AS action_reuse,
    count(*) FILTER (direct_score < offline_policy_oracle_score AND candidate_set_oracle_reuse_score < offline_policy_oracle_score) AS action_fresh FROM b)
  SELECT * EXCLUDE (dm, rm, pm), round(dm, 9) AS direct_mean, round(rm, 9) AS candidate_set_oracle_reuse_mean, round(pm, 9) AS offline_policy_oracle_mean, round(candidate_count / target_count, 9) AS mean_candidate_count,
    round(pair_harm_count / candidate_count, 9) AS pair_harm_rate, round(helpful_target_count / target_count, 9) AS helpful_coverage, round(harmful_target_count / target_count, 9) AS harmful_coverage,
    round(candidate_set_reuse_target_harm_count / target_count, 9) AS candidate_set_reuse_target_harm_rate, round(rm - dm, 9) AS reuse_gain_over_direct, round(pm - dm, 9) AS policy_gain_over_direct, round(pm - rm, 9) AS policy_gain_over_reuse FROM s"""
)
_PAIR = "target_query_id || '/' || experience_id"
SQL["oracle_violations"] = (
    _with("raw_oracle_rows")
    + ", g AS (SELECT target_query_id, min(direct_score) <> max(direct_score) AS d, min(fresh_score) <> max(fresh_score) OR (count(fresh_score) <> 0 AND count(fresh_score) <> count(*)) AS f, min(requested_top_k) <> max(requested_top_k) AS b, count(DISTINCT candidate_rank) <> count(*) AS r FROM raw_oracle_rows_ GROUP BY 1) "
    + counted(
        "SELECT 'several_memory_snapshots' AS rule, '*' AS key FROM (SELECT count(DISTINCT memory_snapshot_id) AS n FROM raw_oracle_rows_) WHERE n > 1",
        f"SELECT 'duplicate_pair', {_PAIR} FROM raw_oracle_rows_ GROUP BY target_query_id, experience_id HAVING count(*) > 1",
        rules("g", "target_query_id", [("d", "inconsistent_direct_score"), ("f", "inconsistent_fresh_score"), ("b", "inconsistent_budget"), ("r", "duplicate_rank")]),
        rules("raw_oracle_rows_", _PAIR, [("direct_score > 1", "direct_score_out_of_range"), ("reuse_score > 1", "reuse_score_out_of_range"), ("fresh_score > 1", "fresh_score_out_of_range"), ("candidate_rank < 1", "candidate_rank_not_positive"), ("requested_top_k < 1", "requested_top_k_not_positive")]),
    )
)

_KEYED = "concat_ws('/', target_query_id, experience_id)"
_RANGE = "({0} IS NULL OR NOT ({0} >= 0 AND {0} <= 1))"
SQL["oracle_rule_breaks"] = (
    _with("planted_oracle_rows")
    + """, g AS (SELECT target_query_id, min(direct_score) <> max(direct_score) AS d, min(fresh_score) <> max(fresh_score) OR (count(fresh_score) <> 0 AND count(fresh_score) <> count(*)) AS f,
  coalesce(min(requested_top_k) <> max(requested_top_k), false) OR coalesce(min(context_token_budget) <> max(context_token_budget), false) OR coalesce(min(retrieval_query_count) <> max(retrieval_query_count), false) AS b, count(DISTINCT candidate_rank) <> count(*) AS r FROM planted_oracle_rows_ GROUP BY 1) """
    + counted(
        "SELECT 'several_memory_snapshots' AS rule, '*' AS key FROM (SELECT count(DISTINCT memory_snapshot_id) AS n FROM planted_oracle_rows_) WHERE n > 1",
        f"SELECT 'duplicate_pair', {_KEYED} FROM planted_oracle_rows_ GROUP BY target_query_id, experience_id HAVING count(*) > 1",
        rules("g", "target_query_id", [("d", "inconsistent_direct_score"), ("f", "inconsistent_fresh_score"), ("b", "inconsistent_budget"), ("r", "duplicate_rank")]),
        rules(
            "planted_oracle_rows_", _KEYED,
            [(f"trim(coalesce({c}, '')) = ''", f"blank_{c}") for c in ("target_query_id", "experience_id", "memory_snapshot_id")] + [(_RANGE.format(c), f"{c}_out_of_range") for c in ("direct_score", "reuse_score")]
            + [("fresh_score IS NOT NULL AND " + _RANGE.format("fresh_score"), "fresh_score_out_of_range")] + [(f"coalesce({c}, 0) < 1", f"{c}_not_positive") for c in ("candidate_rank", "retrieval_query_count", "requested_top_k", "context_token_budget")],
        ),
    )
)


def _reliability(source: str) -> str:
    o = outcome()
    return f"""SELECT experience_id, count(*) AS n, count(*) FILTER ({o} = 'direct_bad_reuse_good') AS benefit, count(*) FILTER ({o} = 'direct_good_reuse_bad') AS harm, count(*) FILTER ({o} = 'direct_good_reuse_good') AS good,
    count(*) FILTER ({o} = 'direct_bad_reuse_bad') AS bad, avg(reuse_score - direct_score) AS mean FROM {source} GROUP BY experience_id"""


_COUNTS = "coalesce(n, 0) AS n, coalesce(benefit, 0) AS benefit, coalesce(harm, 0) AS harm, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, coalesce(mean, 0e0) AS mean"
SQL["reliability_summary"] = f"""{_with("observations", "sources")}, a AS ({_reliability("observations_")}), r AS (SELECT s.experience_id, {_COUNTS} FROM sources_ s LEFT JOIN a USING (experience_id))
SELECT experience_id, n AS observations, benefit AS benefit_count, harm AS harm_count, round(mean, 9) AS mean_gain, round({div("harm", "n")}, 9) AS harm_rate, round({div("benefit", "n")}, 9) AS benefit_rate, harm + good AS direct_good_count,
  benefit + bad AS direct_bad_count, round({div("harm", "(harm + good)")}, 9) AS conditional_breakage_rate, round({div("benefit", "(benefit + bad)")}, 9) AS repair_rate, round({wilson("harm", "(harm + good)")}, 9) AS breakage_upper_bound, round({wilson("harm", "n")}, 9) AS harm_upper_bound FROM r"""
SQL["wilson_bound"] = f"{_with('oracle_rows')}, a AS (SELECT experience_id, count(*) AS n, count(*) FILTER (reuse_score < 0.25e0) AS k FROM oracle_rows_ GROUP BY 1) SELECT experience_id, n, k, round({wilson('k', 'n')}, 9) AS bound FROM a"


def _lifecycle(p) -> str:
    o = outcome()
    run = "OVER (PARTITION BY experience_id ORDER BY seq)"
    return f"""r AS (SELECT experience_id, count(*) {run} AS n, count(*) FILTER ({o} = 'direct_bad_reuse_good') {run} AS benefit, count(*) FILTER ({o} = 'direct_good_reuse_bad') {run} AS harm, count(*) FILTER ({o} = 'direct_good_reuse_good') {run} AS good,
    sum(reuse_score - direct_score) {run} AS gain FROM observations_),
  states AS (SELECT experience_id, max(n) AS observations, CASE WHEN max(harm) >= {p.quarantine_at_harm_count} THEN 'quarantine' WHEN bool_or(n >= {p.promotion_min_observations} AND harm + good >= {p.promotion_min_direct_good_observations} AND benefit >= {p.promotion_min_benefits} AND gain > 0
    AND {wilson("harm", "(harm + good)")} <= {p.promotion_max_wilson_breakage_upper_bound}e0) THEN 'active' ELSE 'candidate' END AS state FROM r GROUP BY experience_id)"""


from .policies import LifecyclePolicy  # noqa: E402

SQL["lifecycle"] = f"{_with('observations')}, {_lifecycle(LIFECYCLE)} SELECT * FROM states"
SQL["lifecycle_default"] = f"{_with('observations')}, {_lifecycle(LifecyclePolicy())} SELECT * FROM states"
SQL["state_histogram"] = f"{_with('observations')}, {_lifecycle(LIFECYCLE)} SELECT state, count(*) AS n FROM states GROUP BY state"
SQL["write_gate"] = f"{_with('sources')} SELECT experience_id, 'candidate' AS state, reuse_score - direct_score AS gain FROM sources_ WHERE reuse_score - direct_score > 0 AND evidence_role <> 'test'"
SQL["transfer_violations"] = (
    _with("observations", "sources")
    + """, j AS (SELECT o.*, s.state AS st, s.source_query_id AS sq, s.source_dataset_id AS sd, s.source_group_id AS sg, s.source_metric_protocol_id AS sm, s.source_applier_id AS sa, s.source_applier_version AS sv,
  row_number() OVER (PARTITION BY experience_id, dataset_id, o.target_query_id ORDER BY seq) AS t2, row_number() OVER (PARTITION BY experience_id, dataset_id, target_group_id ORDER BY seq) AS g2
  FROM observations_ o LEFT JOIN sources_ s USING (experience_id)) """
    + counted(
        rules(
            "j", "experience_id || '/' || cast(seq AS varchar)",
            [
                ("st IS NULL", "unknown_experience"), ("st = 'retired'", "retired_experience"), ("evidence_role = 'test'", "test_evidence"), ("target_query_id = sq", "source_query_as_transfer"), ("dataset_id = sd AND target_group_id = sg", "source_group_as_transfer"),
                ("metric_protocol_id <> sm", "metric_protocol_differs"), ("applier_id <> sa OR applier_version <> sv", "applier_differs"), ("t2 > 1", "duplicate_target"), ("g2 > 1", "duplicate_group"),
            ],
        )
    )
)
_ILLEGAL = "st IS NULL OR st = 'retired' OR evidence_role = 'test' OR target_query_id = sq OR (dataset_id = sd AND target_group_id = sg) OR metric_protocol_id <> sm OR applier_id <> sa OR applier_version <> sv OR t2 > 1 OR g2 > 1"
_LEGAL = f"""{_with("observations", "sources").replace("observations_ AS", "given AS", 1)}, admitted AS (SELECT * FROM sources_ WHERE reuse_score - direct_score > 0 AND evidence_role <> 'test'),
  j AS (SELECT o.*, s.state AS st, s.source_query_id AS sq, s.source_dataset_id AS sd, s.source_group_id AS sg, s.source_metric_protocol_id AS sm, s.source_applier_id AS sa, s.source_applier_version AS sv,
    row_number() OVER (PARTITION BY experience_id, dataset_id, o.target_query_id ORDER BY seq) AS t2, row_number() OVER (PARTITION BY experience_id, dataset_id, target_group_id ORDER BY seq) AS g2 FROM given o JOIN admitted s USING (experience_id)),
  observations_ AS (SELECT * FROM j WHERE NOT coalesce({_ILLEGAL}, false)), {_lifecycle(LIFECYCLE)}, rel AS ({_reliability("observations_")})"""
SQL["ledger_ingest"] = f"""{_LEGAL}
  SELECT a.experience_id, CASE WHEN a.state = 'retired' THEN 'retired' ELSE coalesce(t.state, 'candidate') END AS state, coalesce(n, 0) AS n, coalesce(benefit, 0) AS benefit, coalesce(harm, 0) AS harm, coalesce(good, 0) AS both_good, round(coalesce(n * mean, 0e0), 9) AS gain
  FROM admitted a LEFT JOIN states t USING (experience_id) LEFT JOIN rel USING (experience_id)"""
SQL["source_snapshot"] = f"""{_LEGAL}
  SELECT a.experience_id, coalesce(t.state, 'candidate') AS state, source_query_id, reuse_score - direct_score AS source_gain, coalesce(n, 0) AS n, round(coalesce(n * mean, 0e0), 9) AS gain, coalesce(benefit, 0) AS benefit
  FROM admitted a LEFT JOIN states t USING (experience_id) LEFT JOIN rel USING (experience_id)"""
SQL["source_oracle_csv"] = f"""{_with("oracle_rows")} SELECT CASE WHEN cast(target_query_id AS bigint) % 7 = 0 THEN 'of "two"' || chr(10) || 'lines ' || target_query_id ELSE target_query_id END AS target_query_id, experience_id, memory_snapshot_id,
  candidate_rank::bigint AS candidate_rank, direct_score, reuse_score, retrieval_query_count::bigint AS retrieval_query_count, requested_top_k::bigint AS requested_top_k, context_token_budget::bigint AS context_token_budget, fresh_score FROM oracle_rows_"""
SQL["source_plan_bundle"] = f"{_with('plans')} SELECT *, 'precomputed-plan' AS applier_id, 'v1' AS application_version FROM plans_"
SQL["source_requests"] = f"""{_with("requests")} SELECT target_query_id, md5('q ' || coalesce(target_query, '')) AS query_md5, length('q ' || coalesce(target_query, '')) AS n_chars,
  array_to_string(list_sort(list_distinct(list_filter(string_split(signatures, '|'), lambda x: x <> ''))), '|') AS signatures, 'query_only' AS signature_input_scope FROM requests_"""
SQL["record_violations"] = (
    f"{_with('observations', 'sources')}, {_lifecycle(LIFECYCLE)}, j AS (SELECT s.*, t.state AS expected FROM sources_ s LEFT JOIN states t USING (experience_id)) "
    + counted(
        rules(
            "j", "experience_id",
            [
                ("evidence_role = 'test'", "test_source_evidence"), ("NOT (reuse_score - direct_score > minimum_gain)", "source_fails_write_gate"), ("lower(stored_dataset_id) <> 'unset' AND stored_dataset_id <> source_dataset_id", "source_dataset_id_contradicted"),
                ("state <> 'retired' AND state <> coalesce(expected, 'candidate')", "state_contradicts_evidence"),
            ],
        )
    )
)
_PORT = f"""{_with("observations", "activities")}, {_lifecycle(LIFECYCLE)}, rel AS ({_reliability("observations_")}),
  act AS (SELECT rel.*, {div("benefit", "n")} * (1e0 - {wilson("harm", "(harm + good)")}) AS base FROM rel JOIN states USING (experience_id) WHERE state = 'active'),
  sc AS (SELECT experience_id, base, pow(0.5e0, (30 - last_validated_step) / {PORTFOLIO.half_life_steps}e0) AS decay, (30 - last_validated_step)::bigint AS age FROM act JOIN activities_ USING (experience_id) WHERE last_validated_step IS NOT NULL),
  pr AS (SELECT *, base * decay AS priority FROM sc)"""
SQL["portfolio_scores"] = _PORT + " SELECT experience_id, round(base, 9) AS priority_base, round(decay, 9) AS decay, age AS age_steps, round(priority, 9) AS priority FROM pr"
SQL["portfolio_partition"] = (
    _PORT
    + f""", k AS (SELECT *, row_number() OVER (ORDER BY priority >= {PORTFOLIO.minimum_priority}e0 DESC, priority DESC, experience_id) AS nth FROM pr)
  SELECT experience_id, round(priority, 9) AS priority, CASE WHEN priority < {PORTFOLIO.minimum_priority}e0 THEN 'expired' WHEN nth <= {PORTFOLIO.capacity} THEN 'hot' ELSE 'cold' END AS tier, CASE WHEN priority >= {PORTFOLIO.minimum_priority}e0 AND nth <= {PORTFOLIO.capacity} THEN nth ELSE 0 END AS hot_rank FROM act LEFT JOIN k USING (experience_id)"""
)
SQL["tier_violations"] = f"{_with('tier_records', 'stored_tiers')}, a AS (SELECT experience_id FROM tier_records_ WHERE state = 'active'), t AS (SELECT experience_id, count(*) AS n, count(DISTINCT tier) AS k FROM stored_tiers_ GROUP BY 1) " + counted(
    "SELECT CASE WHEN k > 1 THEN 'tiers_overlap' ELSE 'repeated_in_tier' END AS rule, experience_id AS key FROM t WHERE n > 1",
    "SELECT 'active_without_tier', experience_id FROM a WHERE experience_id NOT IN (SELECT experience_id FROM t)",
    "SELECT 'tier_of_inactive', experience_id FROM t WHERE experience_id NOT IN (SELECT experience_id FROM a)",
    rules("stored_tiers_", "experience_id", [("tier NOT IN ('hot', 'cold', 'expired')", "unknown_tier"), ("(tier = 'hot') <> (hot_rank IS NOT NULL)", "hot_rank_contradicts_tier")]),
    f"SELECT 'hot_above_capacity', '*' FROM (SELECT count(*) AS n FROM stored_tiers_ WHERE tier = 'hot') WHERE n > {PORTFOLIO.capacity}",
)
SQL["activity_violations"] = f"{_with('activities', 'sources')} " + counted(
    "SELECT 'unknown_experience' AS rule, experience_id AS key FROM activities_ WHERE experience_id NOT IN (SELECT experience_id FROM sources_)",
    rules("activities_", "experience_id", [("last_validated_step IS NULL OR last_validated_step < 0", "last_validated_step_invalid"), ("last_validated_step > 29", "last_validated_step_in_future"), ("last_used_step > 29", "last_used_step_in_future")]),
)


def _env(tiered: bool) -> str:
    unknown = {f: f"lower(trim({f})) IN ('', 'unset', 'unspecified', 'unknown')" for f in RETRIEVAL_FIELDS}
    differs = {f: f"{f} <> '{CURRENT[f]}'" for f in RETRIEVAL_FIELDS}
    names = lambda fs, conds: "list_filter([" + ", ".join(f"CASE WHEN {conds[f]} THEN '{f}' END" for f in fs) + "], lambda x: x IS NOT NULL)"
    first = names(RETRIEVAL_FIELDS, unknown)
    second = names(HARD_FIELDS if tiered else RETRIEVAL_FIELDS, differs)
    soft = names(SOFT_FIELDS, {f: f"NOT ({unknown[f]}) AND {differs[f]}" for f in SOFT_FIELDS}) if tiered else "[]::varchar[]"
    p = TIERED.soft_mismatch_penalty if tiered else 0.0
    return f"""{_with("environments")}, a AS (SELECT experience_id, {first} AS u, {second} AS d, {soft} AS s FROM environments_), b AS (SELECT experience_id, u || list_filter(d, lambda x: NOT list_contains(u, x)) AS h, s FROM a),
  c AS (SELECT *, CASE WHEN len(h) = 0 THEN greatest(0e0, 1e0 - len(s) * {p}::double) ELSE 0e0 END AS score FROM b)
  SELECT experience_id, len(h) = 0 {"AND score >= " + str(TIERED.minimum_score) + "::double" if tiered else ""} AS environment_compatible, round(score, 9) AS environment_score, array_to_string(h, '|') AS hard, array_to_string(s, '|') AS soft FROM c"""


SQL["env_strict"], SQL["env_tiered"] = _env(False), _env(True)


def folded(c: str) -> str:
    """Unicode case folding of every character."""
    singles, to, several = fold_table()
    for k, v in several.items():
        c = f"replace({c}, '{k}', '{v}')"
    return f"translate({c}, '{singles}', '{to}')"


def words(c: str) -> str:
    """Words are cut, then folded together."""
    found = rf"array_to_string(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), ' ')"
    return f"list_filter(list_distinct(string_split({folded(found)}, ' ')), lambda w: w <> '')"


_JACCARD = "CASE WHEN len(w) = 0 AND len(v) = 0 THEN 1e0 ELSE len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v)))::double END"
SQL["token_jaccard"] = f"{_with('requests', 'memory')}, j AS (SELECT target_query_id, {words('target_query')} AS w, {words('source_query')} AS v FROM requests_ r JOIN memory_ m ON m.item_id = cast(substr(r.target_query_id, 2) AS bigint) % (SELECT max(item_id) + 1 FROM memory_)) SELECT target_query_id, round({_JACCARD}, 9) AS score FROM j"


def _recall(pool: str) -> str:
    return f"""rt AS (SELECT target_query_id, {words("target_query")} AS w FROM requests_), re AS (SELECT experience_id, {words("source_query")} AS v FROM memory_ {pool}),
  rs AS (SELECT target_query_id, experience_id, {_JACCARD} AS recall_score FROM rt, re),
  recalled AS (SELECT *, row_number() OVER (PARTITION BY target_query_id ORDER BY recall_score DESC, experience_id) AS recall_rank FROM rs QUALIFY recall_rank <= 5)"""


SQL["recall_topm"] = f"{_with('requests', 'memory')}, {_recall('')} SELECT target_query_id, experience_id, round(recall_score, 9) AS recall_score, recall_rank FROM recalled"

_LIST = "list_filter(string_split({}, '|'), lambda x: x <> '')"
SQL["applicability_coverage"] = f"""{_with("signatures")}, a AS (SELECT id, list_sort(list_distinct({_LIST.format("lower(required)")})) AS req, {_LIST.format("lower(observed)")} AS obs, {_LIST.format("lower(contra)")} AS con FROM signatures_),
  b AS (SELECT *, list_filter(req, lambda x: list_contains(obs, x)) AS m, list_filter(con, lambda x: list_contains(obs, x)) AS vt FROM a)
  SELECT id, round(CASE WHEN len(vt) > 0 OR len(req) = 0 OR len(obs) = 0 THEN 0e0 ELSE len(m) / len(req)::double END, 9) AS score, array_to_string(CASE WHEN len(vt) = 0 AND (len(req) = 0 OR len(obs) = 0) THEN []::varchar[] ELSE m END, '|') AS matched, array_to_string(vt, '|') AS vetoes,
    len(vt) = 0 AND (len(req) = 0 OR len(obs) = 0) AS missing FROM b"""

_POOL = "WHERE state = 'active' AND corpus_id = 'wiki'"
_GATE = f"""{_with("requests", "memory", "memory_observations")}, {_recall(_POOL + " AND experience_id IN (SELECT experience_id FROM memory_observations_)")}, rel AS ({_reliability("memory_observations_")}),
  k AS (SELECT r.*, q.target_query, q.signatures, m.*, rel.* EXCLUDE (experience_id), cast(substr(r.target_query_id, 2) AS bigint) + m.item_id AS kk FROM recalled r JOIN requests_ q USING (target_query_id) JOIN memory_ m USING (experience_id) JOIN rel USING (experience_id)),
  p AS (SELECT *, kk % 4 <> 0 AND target_query_id <> source_query_id AS has_plan, trim(target_query, E' \\t\\n\\r') AS tq,
    trim(CASE WHEN kk % 7 = 0 THEN target_query WHEN kk % 5 = 0 THEN '  ' WHEN kk % 11 = 0 THEN repeat('x', 500) ELSE 'plan ' || cast(kk AS varchar) END, E' \\t\\n\\r') AS pq,
    list_sort(list_distinct({_LIST.format("required")})) AS req, list_distinct({_LIST.format("signatures")}) AS obs, {_LIST.format("contra")} AS con, {wilson("harm", "(harm + good)")} AS risk FROM k),
  f AS (SELECT *, list_filter(req, lambda x: list_contains(obs, x)) AS m, list_filter(con, lambda x: list_contains(obs, x)) AS vt FROM p),
  s AS (SELECT *, CASE WHEN len(vt) > 0 THEN 0e0 ELSE len(m) / len(req)::double END AS fit FROM f),
  w AS (SELECT *, list_filter([CASE WHEN provenance = 'unset' THEN 'missing_provenance' END, CASE WHEN n < {GATE.minimum_observations} THEN 'insufficient_reliability_observations' END, CASE WHEN benefit < {GATE.minimum_benefits} THEN 'insufficient_reliability_benefits' END,
      CASE WHEN mean <= 0 THEN 'reliability_mean_gain_too_low' END, CASE WHEN risk > {GATE.maximum_risk_upper_bound}::double THEN 'risk_upper_bound_too_high' END], lambda x: x IS NOT NULL) AS early,
    CASE WHEN NOT has_plan THEN ['missing_prepared_query_plan'] ELSE list_filter([CASE WHEN pq = '' THEN 'empty_transformed_query' END, CASE WHEN pq <> '' AND replace(lower(pq), 'ß', 'ss') = replace(lower(tq), 'ß', 'ss') THEN 'unchanged_transformed_query' END,
      CASE WHEN length(pq) > {BUDGET.max_query_characters} THEN 'transformed_query_too_long' END, CASE WHEN item_id % 13 = 0 THEN 'application_version_mismatch' END], lambda x: x IS NOT NULL) END AS planned,
    list_filter([CASE WHEN len(vt) > 0 THEN 'applicability_contraindication_matched' END, CASE WHEN fit < {GATE.minimum_applicability}::double THEN 'applicability_below_threshold' END], lambda x: x IS NOT NULL) AS fitted FROM s),
  g AS (SELECT *, early || planned || fitted AS why FROM w)"""
SQL["plan_reasons"] = _GATE + " SELECT target_query_id, experience_id, array_to_string(planned, '|') AS reasons FROM g"
SQL["gate_traces"] = (
    _GATE
    + " SELECT target_query_id, experience_id, recall_rank, n AS reliability_observations, round(mean, 9) AS reliability_mean_gain, round(risk, 9) AS risk_upper_bound, round(fit, 9) AS applicability_score, len(why) = 0 AS passed, len(early) + len(fitted) = 0 AS semantic_intent_valid, array_to_string(why, '|') AS reasons FROM g"
)
_KEY = "fit DESC, risk, recall_rank, experience_id"
SQL["gate_decisions"] = (
    _GATE
    + f""", b AS (SELECT target_query_id, first(experience_id ORDER BY {_KEY}) FILTER (len(why) = 0) AS won, first(pq ORDER BY {_KEY}) FILTER (len(why) = 0) AS wq, first(experience_id ORDER BY {_KEY}) FILTER (len(early) + len(fitted) = 0) AS meant FROM g GROUP BY 1)
  SELECT target_query_id, CASE WHEN won IS NOT NULL OR meant IS NOT NULL THEN 'reuse' ELSE 'direct' END AS intended_action, coalesce(won, meant) AS intended_experience_id, CASE WHEN won IS NOT NULL THEN 'reuse' ELSE 'direct' END AS executed_action, won AS executed_experience_id,
    md5(coalesce(wq, trim(target_query, E' \\t\\n\\r'))) AS query_md5, CASE WHEN won IS NOT NULL THEN 'reuse_selected' WHEN b.target_query_id IS NULL THEN 'no_candidates' WHEN meant IS NOT NULL THEN 'invalid_query_plan_fallback' ELSE 'no_eligible_experience' END AS reason
  FROM requests_ LEFT JOIN b USING (target_query_id)"""
)


def _changed(sql: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        if old not in sql:
            raise ValueError(f"not in the SQL: {old}")
        sql = sql.replace(old, new)
    return sql


_HOOKED = _changed(
    _GATE,
    (
        _recall(_POOL + " AND experience_id IN (SELECT experience_id FROM memory_observations_)"),
        f"""rq AS (SELECT target_query_id, list_distinct({_LIST.format("signatures")}) AS sg FROM requests_), rx AS (SELECT target_query_id, len(sg) AS c, unnest(sg) AS x FROM rq),
  rm AS (SELECT experience_id, unnest(list_distinct({_LIST.format("required")})) AS x FROM memory_ {_POOL} AND experience_id IN (SELECT experience_id FROM memory_observations_)),
  rp AS (SELECT target_query_id, experience_id, count(*) / max(c)::double AS recall_score FROM rx JOIN rm USING (x) GROUP BY 1, 2),
  recalled AS (SELECT *, row_number() OVER (PARTITION BY target_query_id ORDER BY recall_score DESC, experience_id) AS recall_rank FROM rp QUALIFY recall_rank <= 4)""",
    ),
    ("kk % 4 <> 0 AND target_query_id <> source_query_id AS has_plan", "target_query_id <> source_query_id AS has_plan"),
    ("CASE WHEN kk % 7 = 0 THEN target_query WHEN kk % 5 = 0 THEN '  ' WHEN kk % 11 = 0 THEN repeat('x', 500) ELSE 'plan ' || cast(kk AS varchar) END", "'rewrite for ' || experience_id"),
    ("CASE WHEN len(vt) > 0 THEN 0e0 ELSE len(m) / len(req)::double END AS fit", "0.75e0 AS fit"),
)
SQL["hooked_decisions"] = (
    _HOOKED
    + f""", b AS (SELECT target_query_id, first(experience_id ORDER BY {_KEY}) FILTER (len(why) = 0) AS won, first(experience_id ORDER BY {_KEY}) FILTER (len(early) + len(fitted) = 0) AS meant FROM g GROUP BY 1)
  SELECT target_query_id, experience_id, recall_rank, len(why) = 0 AS passed, array_to_string(why, '|') AS reasons, won AS executed_experience_id,
    CASE WHEN won IS NOT NULL THEN 'reuse_selected' WHEN meant IS NOT NULL THEN 'invalid_query_plan_fallback' ELSE 'no_eligible_experience' END AS reason, 'shared-signatures' AS recall_scorer_id FROM g JOIN b USING (target_query_id)"""
)
_O = outcome("d", "r", "0.5e0")
_CHOSEN = (
    _GATE
    + f""", pts(op_seq, minimum_applicability, maximum_risk_upper_bound) AS (VALUES {", ".join(f"({a}, {b}::double, {c}::double)" for a, b, c in POINTS)}),
  el AS (SELECT g.*, (cast(substr(target_query_id, 2) AS bigint) % 9) / 8e0 AS d, (kk % 9) / 8e0 AS r FROM g WHERE len(list_filter(why, lambda x: x NOT IN ('risk_upper_bound_too_high', 'applicability_below_threshold'))) = 0),
  ch AS (SELECT op_seq, target_query_id, experience_id, d, r FROM el JOIN pts ON fit >= minimum_applicability AND risk <= maximum_risk_upper_bound QUALIFY row_number() OVER (PARTITION BY op_seq, target_query_id ORDER BY {_KEY}) = 1)"""
)
SQL["selective_sweep"] = (
    _CHOSEN
    + f""",
  ag AS (SELECT op_seq, count(*) AS n, count(*) FILTER ({_O} = 'direct_bad_reuse_good') AS benefit, count(*) FILTER ({_O} = 'direct_good_reuse_bad') AS harm, count(*) FILTER ({_O} = 'direct_good_reuse_good') AS good, count(*) FILTER ({_O} = 'direct_bad_reuse_bad') AS bad, avg(r - d) AS mean FROM ch GROUP BY 1),
  al AS (SELECT pts.*, (SELECT count(*) FROM requests_) AS target_count, {_COUNTS} FROM pts LEFT JOIN ag USING (op_seq))
  SELECT op_seq::bigint AS op_seq, minimum_applicability, maximum_risk_upper_bound, target_count, n AS accepted_count, benefit AS benefit_count, harm AS harm_count, good AS both_good_count, bad AS both_bad_count, round(mean, 9) AS mean_gain, round({div("n", "target_count")}, 9) AS coverage,
    round({div("harm", "n")}, 9) AS accepted_harm_rate, round({div("harm", "(harm + good)")}, 9) AS conditional_breakage_rate, round({div("benefit", "(benefit + bad)")}, 9) AS repair_rate FROM al"""
)
SQL["selective_pairs"] = _CHOSEN + " SELECT op_seq::bigint AS op_seq, target_query_id, experience_id FROM ch"
SQL["hot_recall"] = f"""{_with("requests", "memory", "memory_observations", "memory_activities")}, rel AS ({_reliability("memory_observations_")}),
  hot AS (SELECT experience_id FROM (SELECT experience_id, {div("benefit", "n")} * (1e0 - {wilson("harm", "(harm + good)")}) * pow(0.5e0, (30 - last_validated_step) / {HOT.half_life_steps}e0) AS pr
    FROM memory_ JOIN rel USING (experience_id) JOIN memory_activities_ USING (experience_id) WHERE state = 'active' AND last_validated_step IS NOT NULL) WHERE pr >= {HOT.minimum_priority}e0 ORDER BY pr DESC, experience_id LIMIT {HOT.capacity}),
  {_recall(_POOL + " AND experience_id IN (SELECT experience_id FROM hot)")} SELECT target_query_id, experience_id, round(recall_score, 9) AS recall_score, recall_rank FROM recalled"""
SQL["episode_verifications"] = f"{_with('events')} SELECT verification_id, target, source, verdict, score FROM events_ WHERE episode_id = '7'"
SQL["selective_violations"] = (
    _with("raw_oracle_rows", "oracle_rows")
    + ", u AS (SELECT DISTINCT target_query_id FROM oracle_rows_ WHERE cast(target_query_id AS bigint) % 101 <> 0) "
    + counted(
        f"SELECT 'duplicate_pair' AS rule, {_PAIR} AS key FROM raw_oracle_rows_ GROUP BY target_query_id, experience_id HAVING count(*) > 1",
        "SELECT 'duplicate_rank', target_query_id FROM raw_oracle_rows_ GROUP BY target_query_id, candidate_rank HAVING count(*) > 1",
        "SELECT DISTINCT 'target_outside_universe', target_query_id FROM raw_oracle_rows_ WHERE target_query_id NOT IN (SELECT target_query_id FROM u)",
        "SELECT 'inconsistent_target_protocol', target_query_id FROM raw_oracle_rows_ GROUP BY target_query_id HAVING min(direct_score) <> max(direct_score)",
        f"SELECT 'score_out_of_range', {_PAIR} FROM raw_oracle_rows_ WHERE direct_score > 1 OR reuse_score > 1",
    )
)
_TURN = "episode_id || '#' || cast(turn_index AS varchar)"
SQL["turn_violations"] = f"{_with('turns')} " + counted(
    rules(
        "turns_", _TURN,
        [
            ("trim(operator) = ''", "blank_operator"), ("action = 'reuse_repair' AND experience_card_version IS NULL", "reuse_without_card"), ("action <> 'reuse_repair' AND experience_card_version IS NOT NULL", "card_without_reuse"), ("n_text % 9 = 0", "not_one_query"),
            ("sufficiency = 'sufficient'", "sufficient_with_gaps"), ("n_text % 10 > 8", "duplicate_ratio_invalid"), ("n_text < 20", "output_tokens_negative"),
        ],
    )
)
_EPISODES = f"""{_with("turns", "episodes")}, t AS (SELECT x.*, e.terminal_reason, row_number() OVER w AS nth, count(*) OVER (PARTITION BY episode_id) AS cnt, lag(gaps) OVER w AS prior, lead(action) OVER w AS following, count(*) OVER (PARTITION BY episode_id, turn_id) AS same
  FROM turns_ x JOIN episodes_ e USING (episode_id) WINDOW w AS (PARTITION BY episode_id ORDER BY turn_index, turn_id)),
  en AS (SELECT episode_id, count(*) AS n, last(sufficiency ORDER BY turn_index, turn_id) AS suf, last(next_action ORDER BY turn_index, turn_id) AS fin, first(action ORDER BY turn_index, turn_id) AS start, list(turn_id) AS units FROM turns_ GROUP BY 1), e AS (SELECT * FROM episodes_ LEFT JOIN en USING (episode_id))"""
_END = "next_action IN ('answer', 'stop_abstain')"
SQL["episode_violations"] = f"{_EPISODES} " + counted(
    rules(
        "t", _TURN,
        [
            ("same > 1", "duplicate_turn_id"), ("nth = 1 AND action <> 'base'", "first_turn_not_base"), ("nth > 1 AND action = 'base'", "base_after_first_turn"), ("action = 'base' AND targets <> ''", "base_targets_gaps"), ("nth > 1 AND targets = ''", "repair_without_target"),
            ("nth > 1 AND targets <> '' AND targets IS DISTINCT FROM prior", "repair_targets_unknown_gap"), ("sufficiency = 'sufficient' AND next_action <> 'answer'", "sufficient_without_answer"),
            ("sufficiency <> 'sufficient' AND next_action = 'answer' AND NOT (cnt = 1 AND action = 'base' AND terminal_reason = 'baseline_complete')", "answer_without_sufficiency"), (f"{_END} AND nth <> cnt", "terminal_action_before_end"),
            (f"NOT {_END} AND nth = cnt", "end_without_terminal_action"), (f"NOT {_END} AND nth <> cnt AND following <> next_action", "decision_not_executed"),
        ],
    ),
    rules(
        "e", "episode_id",
        [
            ("terminal_reason = 'sufficient' AND (suf <> 'sufficient' OR fin <> 'answer')", "sufficient_end_without_evidence"), ("terminal_reason = 'baseline_complete' AND NOT (n = 1 AND start = 'base')", "baseline_complete_not_direct"),
            ("terminal_reason NOT IN ('sufficient', 'baseline_complete') AND fin <> 'stop_abstain'", "terminal_reason_needs_stop"), ("NOT list_contains(units, CASE WHEN cast(episode_id AS bigint) % 9 = 0 THEN 'u99' ELSE 'u0' END)", "final_evidence_not_retrieved"),
        ],
    ),
)
_VERDICT = "CASE WHEN baseline_score IS NULL THEN NULL WHEN baseline_score >= quality_threshold AND treatment_score < quality_threshold THEN 'fail' WHEN treatment_score >= quality_threshold AND treatment_score > baseline_score THEN 'pass' ELSE 'uncertain' END"
SQL["event_violations"] = f"{_with('events')} " + counted(
    rules(
        "events_", "verification_id",
        [
            ("target = 'paired_benefit' AND direct_baseline_episode_ref IS NULL", "paired_without_baseline"), ("target = 'paired_benefit' AND baseline_score IS NULL", "paired_without_scores"),
            ("target = 'paired_benefit' AND baseline_score IS NOT NULL AND abs(score - (treatment_score - baseline_score)) > 1e-9", "paired_score_not_gain"), (f"target = 'paired_benefit' AND verdict <> {_VERDICT}", "verdict_contradicts_scores"),
            ("target <> 'paired_benefit'", "paired_fields_on_other_target"),
        ],
    )
)
SQL["paired_verdicts"] = f"{_with('events')} SELECT verification_id, {_VERDICT} AS expected_verdict, treatment_score - baseline_score AS paired_gain, baseline_score >= quality_threshold AS baseline_is_correct FROM events_"
SQL["pair_violations"] = (
    f"{_with('turns', 'episodes', 'events')}, arm AS (SELECT e.*, count(*) = 1 AND min(action) = 'base' AS direct, bool_or(action <> 'base') AS repair FROM episodes_ e JOIN turns_ USING (episode_id) GROUP BY ALL), "
    "j AS (SELECT v.*, t.episode_id AS te, b.episode_id AS be, t.original_query AS tq, b.original_query AS bq, t.run_context_id AS tr, b.run_context_id AS br, t.comparison_group_id AS tg, b.comparison_group_id AS bg, b.direct, t.repair, "
    "target = 'paired_benefit' AND te <> be AS both_known FROM events_ v LEFT JOIN arm t ON v.episode_id = t.episode_id LEFT JOIN arm b ON v.direct_baseline_episode_ref = b.episode_id) "
    + counted(
        rules(
            "j", "verification_id",
            [
                ("te IS NULL", "unknown_episode"), ("direct_baseline_episode_ref IS NOT NULL AND be IS NULL", "unknown_baseline"), ("target = 'paired_benefit' AND episode_id = direct_baseline_episode_ref", "paired_with_itself"), ("both_known AND NOT direct", "baseline_not_direct"),
                ("both_known AND NOT repair", "treatment_without_repair"), ("both_known AND tq <> bq", "queries_differ"), ("both_known AND tr <> br", "contexts_differ"), ("both_known AND tg <> bg", "comparison_groups_differ"),
            ],
        )
    )
)
SQL["context_violations"] = f"{_with('episodes')} " + counted("SELECT 'unknown_run_context' AS rule, episode_id AS key FROM episodes_ WHERE run_context_id = 'rc2'", "SELECT 'duplicate_run_context_id', 'rc1'")
SQL["session_violations"] = f"{_with('episodes')}, j AS (SELECT *, 's' || cast(cast(episode_id AS bigint) % 5 AS varchar) AS session_id FROM episodes_) " + counted(
    "SELECT 'session_mismatch' AS rule, session_id || '/' || episode_id AS key FROM j WHERE document_session_id IS DISTINCT FROM session_id"
)
_CARD = "card_id || '@' || version"
_HARM = "harm_count / nullif(direct_correct_trials, 0)::double"
_FAIL = f"""list_filter([CASE WHEN verification_tier NOT IN ('gold', 'human') THEN 'verification tier is not allowed' END, CASE WHEN independent_episode_count < 2 THEN 'too few independent episodes' END, CASE WHEN independent_document_count < 2 THEN 'too few independent documents' END,
  CASE WHEN matched_trials < 2 THEN 'too few matched trials' END, CASE WHEN benefit_count < 2 THEN 'too few beneficial transfers' END, CASE WHEN direct_correct_trials = 0 THEN 'conditional harm is unobserved' WHEN {_HARM} > 0.1::double THEN 'conditional harm exceeds the serving ceiling' END,
  CASE WHEN mean_gain <= 0 THEN 'mean paired gain is not positive' END], lambda x: x IS NOT NULL)"""
SQL["card_policy_failures"] = f"{_with('cards')} SELECT card_id, array_to_string({_FAIL}, '|') AS failures, round({_HARM}, 9) AS harm_rate FROM cards_"
SQL["card_violations"] = f"{_with('cards')} " + counted(
    rules(
        "cards_", _CARD,
        [
            ("harm_count < 0", "harm_count_negative"), ("direct_correct_trials > matched_trials", "direct_correct_above_trials"), ("harm_count > direct_correct_trials", "harm_above_direct_correct"), ("len(list_distinct(string_split(event_ids, '|'))) < 4", "duplicate_event_ids"),
            ("independent_episode_count < 1", "no_independent_episode"), ("independent_document_count < 1", "no_independent_document"), ("independent_document_count > independent_episode_count", "documents_above_episodes"), ("lifecycle_state = 'active' AND (benefit_count < 1 OR mean_gain <= 0)", "active_without_benefit"), (f"lifecycle_state = 'active' AND len({_FAIL}) > 0", "active_against_policy"),
        ],
    )
)
_ALLOWED = "CASE verification_tier WHEN 'gold' THEN source = 'gold' WHEN 'human' THEN source IN ('gold', 'human') WHEN 'multi_judge' THEN source <> 'proxy' ELSE true END"
_STATS = f"""{_with("cards", "events", "turns")}, ci AS (SELECT {_CARD} AS versioned_id, verification_tier, unnest(string_split(event_ids, '|')) AS verification_id FROM cards_), cj AS (SELECT ci.*, v.* EXCLUDE (verification_id), v.episode_id IS NOT NULL AS known FROM ci LEFT JOIN events_ v USING (verification_id)),
  st AS (SELECT versioned_id, count(*) AS trials, count(*) FILTER (verdict = 'pass') AS benefits, count(*) FILTER (verdict = 'uncertain') AS neutrals, count(*) FILTER (verdict = 'fail') AS harms, count(*) FILTER (baseline_score >= quality_threshold) AS direct_correct,
    avg(coalesce(treatment_score - baseline_score, 0e0)) AS gain, count(*) FILTER (NOT known) AS unknown_events, count(*) FILTER (target <> 'paired_benefit') AS unpaired_events, count(episode_id) - count(DISTINCT episode_id) AS dependent_trials, count(*) FILTER (known AND NOT {_ALLOWED}) AS unsupported_sources FROM cj GROUP BY 1)"""
SQL["card_statistics"] = _STATS + " SELECT * EXCLUDE (gain), round(gain, 9) AS observed_gain FROM st"
SQL["registry_violations"] = (
    _STATS
    + f""", cr AS (SELECT *, {_CARD} AS versioned_id, cast(substr(card_id, 2) AS bigint) AS k, cast(cast(substr(card_id, 2) AS bigint) % 60 AS varchar) AS ep FROM cards_),
  sr AS (SELECT cr.versioned_id, cr.ep, t.episode_id, t.action FROM cr LEFT JOIN turns_ t ON t.episode_id = cr.ep AND t.turn_id = 'u1'), dc AS (SELECT versioned_id, count(DISTINCT ep) AS eps, count(DISTINCT episode_id) AS docs FROM sr GROUP BY 1),
  ps AS (SELECT DISTINCT versioned_id, episode_id FROM cj WHERE verdict = 'pass'), rj AS (SELECT cr.*, st.* EXCLUDE (versioned_id), eps, docs FROM cr LEFT JOIN st USING (versioned_id) LEFT JOIN dc USING (versioned_id)) """
    + counted(
        "SELECT 'unknown_parent' AS rule, versioned_id AS key FROM cr WHERE k % 6 = 0",
        "SELECT DISTINCT 'unknown_source_turn', versioned_id FROM sr WHERE action IS NULL",
        "SELECT DISTINCT 'source_turn_is_base', versioned_id FROM sr WHERE action = 'base'",
        "SELECT 'source_without_benefit', cr.versioned_id FROM cr WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.versioned_id = cr.versioned_id AND ps.episode_id = cr.ep)",
        rules(
            "rj", "versioned_id",
            [
                ("unknown_events > 0", "unknown_event"), ("unpaired_events > 0", "event_not_paired"), ("dependent_trials > 0", "trials_not_independent"), ("unsupported_sources > 0", "sources_do_not_support_tier"),
                ("matched_trials <> trials OR benefit_count <> benefits OR neutral_count <> neutrals OR harm_count <> harms OR direct_correct_trials <> direct_correct", "counts_differ_from_events"), ("abs(gain - mean_gain) > greatest(1e-9 * greatest(abs(gain), abs(mean_gain)), 1e-9)", "mean_gain_differs_from_events"),
                ("docs = 0", "no_source_documents"), ("eps <> independent_episode_count", "episode_count_differs"), ("docs <> independent_document_count", "document_count_differs"),
            ],
        ),
    )
)
SQL["normal_forms"] = rf"""{_with("signatures")}, o AS (SELECT id, required, trim(regexp_replace(upper(required) || ' - X  y', '\s+', ' ', 'g')) AS t FROM signatures_)
  SELECT id, lower(t) AS signature, replace(trim(regexp_replace(replace(lower(t), '-', ' '), '\s+', ' ', 'g')), ' ', '_') AS gap, t AS text, CASE WHEN id % 3 = 0 THEN true ELSE false END AS unspecified FROM o"""
