"""Chat formatting: keep maximal conversations, then render them. DataFrame operations only.

Logs often hold a conversation several times as it grew. Every turn adds a hash of its position, role and
text to two running sums, which identify each prefix of a conversation; a conversation whose whole is a
proper prefix of another is dropped by an anti-join on (turns, sums), and of equal ones the least conv_id
stays. The kept ones are rendered as ChatML. Texts are shuffled once, to gather each conversation, which has
to fit in a task's memory as its rendered text does; prefixes and the anti-join handle hashes only.

Defined cases: turns are taken in order of (turn, role, text), nulls first, so ties and gaps in `turn` are
allowed; a null role is rendered as `user` and a null text as an empty one; rows that repeat a turn in full
count once; rows without conv_id form one conversation named null; control markers within texts are broken
by a zero-width space; other columns are ignored; an empty table gives an empty result. Prefixes are equal
when two independent 64-bit sums are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed markers of the ChatML format.
START, END = "<|im_start|>", "<|im_end|>"
_M = (1 << 31) - 1


def _conversations(conv: DataFrame) -> DataFrame:
    """One row of each conversation: its id without null as (_c, _z), and its distinct turns in order."""
    c = F.col("conv_id").cast("long")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    one = conv.select(F.coalesce(c, F.lit(0)).alias("_c"), c.isNull().alias("_z"), turn.alias("t"))
    return one.groupBy("_c", "_z").agg(F.sort_array(F.collect_set("t")).alias("turns"))


def _id(c: str = "_c", z: str = "_z") -> Column:
    return F.when(~F.col(z), F.col(c))


def _who_what(t: Column) -> tuple[Column, Column]:
    return F.coalesce(t["role"], F.lit("user")), F.coalesce(t["text"], F.lit(""))


def _prefixed(conversations: DataFrame) -> DataFrame:
    """Turns with their place, how many there are and the running sums of the prefix that they end; no texts."""
    t = conversations.select("_c", "_z", F.size("turns").cast("long").alias("n"), F.posexplode("turns").alias("nth", "t")).withColumn("nth", F.col("nth") + 1)
    who, what = _who_what(F.col("t"))
    run = Window.partitionBy("_c", "_z").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    hashed = t.select("_c", "_z", "n", "nth", F.xxhash64("nth", who, F.length(what), what).alias("h0"), F.xxhash64(what, who, F.lit("second"), "nth").alias("h1"))
    # halves of 31 and 32 bits add without overflow over 2**31 turns
    halves = lambda h: (F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit((1 << 32) - 1)))
    return hashed.select(_id().alias("conv_id"), "nth", "n", *[F.sum(part).over(run).alias(f"s{k}{i}") for k in (0, 1) for i, part in enumerate(halves(f"h{k}"))])


_SUMS = ["s00", "s01", "s10", "s11"]


def _maximal(conversations: DataFrame) -> DataFrame:
    pre = _prefixed(conversations)
    whole = pre.where("nth = n").groupBy("n", *_SUMS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = pre.where("nth < n").select(F.col("nth").cast("long").alias("n"), *_SUMS).distinct()
    return whole.join(inner, ["n", *_SUMS], "left_anti").select("conv_id", "n", "copies")


def maximal(conv: DataFrame) -> DataFrame:
    """(conv_id, n, copies): the conversations that are no proper prefix of others; copies counts equal ones."""
    return _maximal(_conversations(conv))


def _safe(text: Column) -> Column:
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit(mark[:2] + "​" + mark[2:]))
    return text


def render(conv: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, text of each maximal conversation."""

    def line(t: Column) -> Column:
        who, what = _who_what(t)
        return F.concat(F.lit(START), _safe(who), F.lit("\n"), _safe(what), F.lit(END + "\n"))

    conversations = _conversations(conv)
    c = F.col("conv_id")
    keep = _maximal(conversations).select(F.coalesce(c, F.lit(0)).alias("_c"), c.isNull().alias("_z"), F.col("n").alias("n_turns"), "copies")
    return conversations.join(keep, ["_c", "_z"]).select(_id().alias("conv_id"), "n_turns", "copies", F.array_join(F.transform("turns", line), "").alias("text"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    list({{'r': role, 't': text}} ORDER BY turn, role, text) AS turns,
    string_agg('{START}' || replace(replace(role, '{START}', '<|' || chr(8203) || 'im_start|>'), '{END}', '<|' || chr(8203) || 'im_end|>') || chr(10)
      || replace(replace(text, '{START}', '<|' || chr(8203) || 'im_start|>'), '{END}', '<|' || chr(8203) || 'im_end|>') || '{END}' || chr(10), '' ORDER BY turn, role, text) AS text
  FROM t GROUP BY conv_id
), u AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies, turns, text FROM c GROUP BY n_turns, turns, text
), p AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)
)
SELECT conv_id, n_turns, copies, text FROM u WHERE turns NOT IN (SELECT turns FROM p)
"""
