"""Append plans for evidence and archive tables: new rows are checked against the old, then united."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import versioned_id
from ..operators import cards as card_ops
from ..operators import episodes as ep
from ..operators.evidence_checks import duplicates, raise_if_any, transfer_violations
from ..operators.reliability import lifecycle_state, ready, running_totals, write_gate
from ..policies import CardActivationPolicy, LifecyclePolicy
from ..storage import file_system, written
from .store import BUCKETS, KeyedTable


def add_candidates(records: DataFrame, candidates: DataFrame, minimum_gain: float = 0.0) -> DataFrame:
    """Records with the candidates that pass the write gate; test evidence and known ids are errors."""
    raise_if_any(candidates.where("evidence_role = 'test'").select(F.lit("test_source_evidence").alias("rule"), F.col("experience_id").alias("key")))
    both = records.select("experience_id").unionAll(candidates.select("experience_id"))
    raise_if_any(duplicates(both, "experience_id"))
    return records.unionByName(write_gate(candidates, minimum_gain).select(records.columns))


def record_transfers(records: DataFrame, observations: DataFrame, new: DataFrame, policy: LifecyclePolicy = LifecyclePolicy(), evaluate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records, observations) after appending independent evidence in order of seq; states follow if asked."""
    every = observations.unionByName(new)
    raise_if_any(transfer_violations(every, records))
    if not evaluate:
        return records, every
    state = lifecycle_state(every, policy).select("experience_id", F.col("state").alias("_new"))
    moved = records.join(state, "experience_id", "left").withColumn("state", F.when(F.col("state").isin("retired", "quarantine"), F.col("state")).otherwise(F.coalesce("_new", "state")))
    return moved.select(records.columns), every


def retire(records: DataFrame, experience_ids: list[str]) -> DataFrame:
    """Retirement is final and by hand."""
    return records.withColumn("state", F.when(F.col("experience_id").isin(*experience_ids), "retired").otherwise(F.col("state")))


class Ledger:
    """A ledger in files: one row of running totals for each experience, in buckets, and observations by batch in the same buckets.

    Appending reads and rewrites only the buckets of the experiences that a batch is about: its rows are checked against what these hold, and
    their states follow from the stored totals and the batch alone. Batches come in rising order; one that comes again, as after a failure, is
    taken once. Records: experience_id, state and the source columns that transfer_violations asks for.
    """

    TOTALS = T.StructType([T.StructField(c, T.DoubleType() if c == "gain" else T.LongType()) for c in ("n", "benefit", "harm", "both_good", "gain", "last_seq", "last_batch")])

    def __init__(self, spark: SparkSession, path: str, record_schema: T.StructType, observation_schema: T.StructType, policy: LifecyclePolicy = LifecyclePolicy(), buckets: int = BUCKETS):
        self.spark, self.path, self.policy = spark, path.rstrip("/"), policy
        self.columns = [f.name for f in record_schema.fields]
        self.schema = T.StructType([*record_schema.fields, *self.TOTALS.fields])
        self.observations = KeyedTable(spark, f"{self.path}/observations", observation_schema, ["experience_id"], buckets)

    def totals(self, buckets: list[int] | None = None) -> DataFrame:
        """Records with their totals, of all buckets or of some."""
        full = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        fs, at = file_system(self.spark, f"{self.path}/totals")
        if not fs.exists(at):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(f"{self.path}/totals")
        return rows if buckets is None else rows.where(F.col("bucket").isin(*buckets) if buckets else F.lit(False))

    def records(self) -> DataFrame:
        return self.totals().select(*self.columns)

    def _replace(self, rows: DataFrame) -> None:
        """Rewrite the buckets that rows lie in; others stay as they are. Rows are written elsewhere first, as they come from what goes."""
        rows = written(rows.select(*self.schema.names, self.observations.bucket().alias("bucket")), "ledger")
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/totals")

    def add_candidates(self, candidates: DataFrame, minimum_gain: float = 0.0) -> None:
        """Admit candidates that pass the write gate; test evidence and known ids are errors."""
        old = self.totals(self.observations.touched(candidates))
        known = old.join(candidates.select("experience_id"), "experience_id", "left_semi").select(*self.columns)
        admitted = add_candidates(known, candidates, minimum_gain).join(known.select("experience_id"), "experience_id", "left_anti")
        zero = {f.name: F.lit(-1 if f.name in ("last_seq", "last_batch") else 0).cast(f.dataType) for f in self.TOTALS.fields}
        self._replace(old.select(*self.schema.names).unionByName(admitted.withColumns(zero).select(*self.schema.names)))

    def record_transfers(self, new: DataFrame, batch: int, evaluate: bool = True) -> None:
        """Append independent evidence: observations after the last ones of their experience, by seq."""
        buckets = self.observations.touched(new)
        records = self.totals(buckets)
        raise_if_any(self.violations(new, records, buckets, batch))
        stored = records.select("experience_id", F.col("last_batch").alias("_b"))
        fresh = new.join(stored.where(F.col("_b") < batch), "experience_id", "left_semi")
        run = running_totals(fresh, carried=records.where("n > 0")).withColumn("_ready", ready(self.policy))
        moved = run.groupBy("experience_id").agg(F.max("n").alias("_n"), F.max("benefit").alias("_benefit"), F.max("harm").alias("_harm"), F.max("both_good").alias("_both_good"), F.max_by("gain", "n").alias("_gain"), F.max("seq").cast("long").alias("_last_seq"), F.max("_ready").alias("_ready"))
        state = F.col("state")
        follows = F.when(state.isin("retired", "quarantine"), state).when(F.col("_harm") >= self.policy.quarantine_at_harm_count, "quarantine").when((state == "candidate") & F.col("_ready"), "active").otherwise(state)
        kept = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("n", "benefit", "harm", "both_good", "gain", "last_seq")}
        changed = F.col("_n").isNotNull()
        after = records.join(moved, "experience_id", "left").withColumns({**kept, "last_batch": F.when(changed, F.lit(batch)).otherwise(F.col("last_batch")), "state": F.when(changed, follows).otherwise(state) if evaluate else state})
        after = written(after.select(*self.schema.names), "ledger-after")  # before the batch is there to be read
        self.observations.append(new, batch)
        self._replace(after)

    def violations(self, new: DataFrame, records: DataFrame, buckets: list[int], batch: int) -> DataFrame:
        """(rule, key) against new rows, looking at earlier ones of the same experiences only."""
        names = self.observations.schema.names
        prior = self.observations.read(buckets).where(F.col("batch") != batch).join(new.select("experience_id").distinct(), "experience_id", "left_semi").select(*names)
        key = F.concat_ws("/", "experience_id", "seq").alias("key")
        found = transfer_violations(prior.unionByName(new.select(*names)), records).join(new.select(key).distinct(), "key", "left_semi").select("rule", "key")
        late = new.join(records.select("experience_id", "last_seq", "last_batch"), "experience_id")
        order = F.explode(F.array_compact(F.array(F.when(F.col("last_batch") > batch, "batch_before_last"), F.when((F.col("last_batch") < batch) & (F.col("seq") <= F.col("last_seq")), "seq_not_after_last"))))
        return found.union(late.select(order, key)).union(duplicates(new, "experience_id", "seq"))

    def retire(self, experience_ids: DataFrame) -> None:
        """Retire by hand, for good: experiences of a table of ids."""
        ids = experience_ids.select("experience_id").distinct()
        old = self.totals(self.observations.touched(ids)).join(ids.withColumn("_gone", F.lit(True)), "experience_id", "left")
        raise_if_any(ids.join(self.totals(self.observations.touched(ids)), "experience_id", "left_anti").select(F.lit("unknown_experience").alias("rule"), F.col("experience_id").alias("key")))
        self._replace(old.withColumn("state", F.when(F.col("_gone"), "retired").otherwise(F.col("state"))))


#: Tables of an archive, in the order of their references.
ARCHIVE = ("contexts", "episodes", "turns", "events", "sessions")


#: What rows of a listing are ordered by.
LISTED_BY = {"contexts": ("run_context_id",), "episodes": ("episode_id",), "sessions": ("session_id",), "events": ("verification_id",)}


def listing(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """Contexts, episodes, sessions or events in order of their id, cards in order of card@version. Sorts for output only."""
    if name == "cards":
        return tables[name].orderBy(versioned_id(F.col("card_id"), F.col("version")))
    return tables[name].orderBy(*LISTED_BY[name])


def touched_archive(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What of the archive new rows can contradict, with them: rows of the same keys, and episodes, turns and contexts that they name.

    The old archive being sound, the rules hold for all of it if they hold for this.
    """
    of = lambda name: new.get(name, old[name].limit(0))
    same = lambda name, *keys: old[name].join(of(name).select(*keys).distinct(), list(keys), "left_semi").unionByName(of(name))
    events, sessions = same("events", "verification_id"), same("sessions", "session_id")
    if "turns" in new:  # more turns of an old episode concern the events that name it
        grown = new["turns"].select("episode_id").distinct()
        named = old["events"].join(grown, "episode_id", "left_semi").unionByName(old["events"].join(grown.withColumnRenamed("episode_id", "direct_baseline_episode_ref"), "direct_baseline_episode_ref", "left_semi").select(old["events"].columns))
        events = events.unionByName(named.join(events.select("verification_id"), "verification_id", "left_anti").dropDuplicates(["verification_id"]))
    ids = (
        of("episodes").select("episode_id").union(of("turns").select("episode_id")).union(events.select("episode_id")).union(events.select("direct_baseline_episode_ref"))
        .union(sessions.select(F.explode("episode_ids"))).distinct()
    )
    episodes = old["episodes"].join(ids, "episode_id", "left_semi").unionByName(of("episodes"))
    turns = old["turns"].join(ids, "episode_id", "left_semi").unionByName(of("turns"))
    context_ids = episodes.select("run_context_id").union(of("contexts").select("run_context_id")).distinct()
    contexts = old["contexts"].join(context_ids, "run_context_id", "left_semi").unionByName(of("contexts"))
    return {"contexts": contexts, "episodes": episodes, "turns": turns, "events": events, "sessions": sessions}


def extend_archive(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The archive with the new rows appended; raises if they contradict it or each other. Tables not in new stay.

    The old archive is sound, so only what new rows touch is checked again. `gaps` (episode_id, turn_index, gap_id, category and texts)
    is checked by its own rules where given.
    """
    if "gaps" in new:
        raise_if_any(ep.gap_violations(new["gaps"]))
    part = touched_archive(old, new)
    append_archive(*[part[k] for k in ARCHIVE])
    return {k: old[k].unionByName(new[k]) if k in new else old[k] for k in old}


def append_archive(contexts: DataFrame, episodes: DataFrame, turns: DataFrame, events: DataFrame, sessions: DataFrame) -> None:
    """Raise unless the tables as they would be form a sound archive."""
    for found in (
        ep.context_violations(episodes, contexts), ep.turn_violations(turns), ep.episode_violations(episodes, turns), ep.event_violations(events), ep.pair_violations(events, episodes, turns),
        ep.session_violations(sessions, episodes), duplicates(events, "verification_id"),
    ):
        raise_if_any(found)


def register_cards(cards: DataFrame, new: DataFrame, events: DataFrame, turns: DataFrame, policy: CardActivationPolicy = CardActivationPolicy()) -> DataFrame:
    """Cards with the new versions; raises if any of these breaks a rule or is there already.

    Registered cards passed when they came, so only new ones are checked, with the parents that they name.
    """
    raise_if_any(card_ops.card_violations(new, policy))
    if {"activation", "repair"} <= set(new.columns):
        raise_if_any(card_ops.specification_violations(new))
    own = new.select(versioned_id(F.col("card_id"), F.col("version")).alias("_v"))
    named = cards.withColumn("_v", versioned_id(F.col("card_id"), F.col("version")))
    again = named.join(own, "_v", "left_semi").select(F.lit("duplicate_versioned_id").alias("rule"), F.col("_v").alias("key"))
    raise_if_any(again)
    parents = named.join(new.select(F.explode("parent_versioned_ids").alias("_v")).distinct(), "_v", "left_semi").select(F.col("_v").alias("parent"))
    found = card_ops.registry_violations(new, events, turns)
    known = parents.withColumnRenamed("parent", "_p").distinct()
    missing = new.select(versioned_id(F.col("card_id"), F.col("version")).alias("_v"), F.explode("parent_versioned_ids").alias("_p")).join(known, "_p", "left_anti").join(own.withColumnRenamed("_v", "_p"), "_p", "left_anti")
    raise_if_any(found.where("rule <> 'unknown_parent'").union(missing.select(F.lit("unknown_parent"), "_v")))
    return cards.unionByName(new)
