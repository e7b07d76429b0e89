"""Evidence as a stream: lifecycle state kept per experience, and checked appends. An extension; batch semantics are the same.

Observations of one experience must arrive in order of seq (one source partition per experience, for
example); the state holds counts only, so it doesn't grow with the history.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions.scores import Z95
from ..plans.store import BUCKETS, KeyedTable
from ..policies import LifecyclePolicy

STATE = "n long, benefit long, harm long, both_good long, gain double, state string"
OUTPUT = "experience_id string, observations long, state string"


def upper_bound(k: int, n: int) -> float:
    """Wilson upper bound of one pair of counts."""
    if n == 0:
        return 1.0
    p, z2 = k / n, Z95 * Z95
    return min(1.0, (p + z2 / (2.0 * n) + Z95 * (p * (1 - p) / n + z2 / (4.0 * n * n)) ** 0.5) / (1 + z2 / n))


def lifecycle_stream(observations: DataFrame, policy: LifecyclePolicy = LifecyclePolicy()) -> DataFrame:
    """The state of each experience after every micro-batch that holds evidence of it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, benefit, harm, good, gain, now = state.get if state.exists else (0, 0, 0, 0, 0.0, "candidate")
        rows = pd.concat(list(batches)).sort_values("seq")
        for d, r, t in zip(rows["direct_score"], rows["reuse_score"], rows["good_threshold"], strict=True):
            n, gain = n + 1, gain + (r - d)
            benefit, harm, good = benefit + (d < t <= r), harm + (r < t <= d), good + (d >= t and r >= t)
            if now == "quarantine":
                continue
            if harm >= policy.quarantine_at_harm_count:
                now = "quarantine"
            elif (
                now == "candidate" and n >= policy.promotion_min_observations and harm + good >= policy.promotion_min_direct_good_observations and benefit >= policy.promotion_min_benefits
                and gain / n > policy.promotion_min_mean_gain and upper_bound(harm, harm + good) <= policy.promotion_max_wilson_breakage_upper_bound
            ):
                now = "active"
        state.update((n, int(benefit), int(harm), int(good), float(gain), now))
        yield pd.DataFrame({"experience_id": [key[0]], "observations": [n], "state": [now]})

    src = observations.select("experience_id", "seq", *[F.col(c).cast("double").alias(c) for c in ("direct_score", "reuse_score", "good_threshold")])
    return src.groupBy("experience_id").applyInPandasWithState(step, OUTPUT, STATE, "update", "NoTimeout")


def append_checked(stream: DataFrame, check, path: str, checkpoint: str, key: Sequence[str], buckets: int = BUCKETS):
    """Append each micro-batch to the KeyedTable at path once check(batch) finds no violations and no other batch holds one of its keys.

    The batches that are there are the index of committed keys; of it only the buckets of a batch's own keys are read. A batch that is
    replayed replaces itself.
    """
    table = KeyedTable(stream.sparkSession, path, stream.schema, key, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            table.commit(batch, batch_id, check)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
