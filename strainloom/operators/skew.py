"""Keyed work when a few keys hold most rows.

A sketch finds the heavy keys; their rows meet a broadcast table of those keys (its size is bounded by
1 / share), all other rows go through an ordinary shuffle, and the two results are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainloom.session import BROADCAST_ROWS

#: Counters the sketch keeps for each group; its error is below 4 / counters of the rows.
SKETCH_COUNTERS = 4096


def sketch_heavy_keys(df: DataFrame, key: str, share: float, by: list[str] | None = None) -> DataFrame:
    """Candidate heavy values of `key` (per group of `by`): every value that holds at least `share` of the
    non-null rows, perhaps some that hold a little less.

    One pass with a mergeable frequent-items sketch; no row is shuffled. Returns by + [key, estimate, total].
    Null keys are ignored; an empty table gives no rows. At most ceil(2 / share) values come out for a group.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    by = by or []
    most = min(SKETCH_COUNTERS // 2, int(2 / share) + 1)
    present = df.where(F.col(key).isNotNull())
    grouped = present.groupBy(*by).agg(F.expr(f"approx_top_k(`{key}`, {most}, {SKETCH_COUNTERS})").alias("__top"), F.count(F.lit(1)).alias("total"))
    if not by:
        grouped = grouped.where("total > 0")
    items = grouped.select(*by, "total", F.explode("__top").alias("__item"))
    slack = F.col("total") * (4.0 / SKETCH_COUNTERS)
    return items.select(*by, F.col("__item.item").alias(key), F.col("__item.count").alias("estimate"), "total").where(F.col("estimate") >= F.col("total") * share - slack)


def skew_aggregate(df: DataFrame, keys: list[str], aggs: list[Column], heavy: DataFrame) -> DataFrame:
    """Group by `keys` with the heavy keys apart: their rows are found by a broadcast join with `heavy` (the keys
    only) and combined where they lie, so that one row a key and task is shuffled; the rest is shuffled as usual.

    Rows with a null in a key form no group. The result has one row for each key, heavy or not, and a boolean
    `is_heavy`. Extra columns of df are ignored; repeated rows all count.
    """
    names = heavy.select(*keys).distinct()
    rows = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    hot = rows.join(F.broadcast(names), keys, "left_semi").groupBy(*keys).agg(*aggs).withColumn("is_heavy", F.lit(True))
    rest = rows.join(F.broadcast(names), keys, "left_anti").groupBy(*keys).agg(*aggs).withColumn("is_heavy", F.lit(False))
    return hot.unionByName(rest)


#: Parts that the rows of a heavy key are split in where the other side's rows of such keys are too many to broadcast.
SALTS = 64


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = 0.01, heavy: list[str] | None = None) -> DataFrame:
    """Join a large skewed `left` with `right` on `keys`.

    The right rows of the heavy keys of `left` are broadcast when there are at most BROADCAST_ROWS of them; else the
    heavy left rows are split in SALTS parts and the right rows of those keys repeated for each part. The remaining
    keys take a shuffle join. A left join keeps left rows with null keys. how: inner or left. `heavy` names the heavy
    keys (of a single key column, as text) where they are known; otherwise a sketch of `left` finds them.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    whole = F.to_json(F.struct(*keys)) if len(keys) > 1 else F.col(keys[0]).cast("string")
    if heavy is None:
        heavy = [r[0] for r in sketch_heavy_keys(left.select(whole.alias("__key")), "__key", share).select("__key").collect()]  # at most 2 / share strings
    if not heavy:
        return left.join(right, keys, how)
    is_hot = F.coalesce(whole.isin(heavy), F.lit(False))
    hot_right, hot_left = right.where(is_hot), left.where(is_hot)
    if hot_right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = hot_left.join(F.broadcast(hot_right), keys, how)
    else:
        salted = hot_left.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        copies = hot_right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot = salted.join(copies, [*keys, "__salt"], how).drop("__salt")
    rest = left.where(~is_hot).join(right.where(~is_hot), keys, how)
    return hot.unionByName(rest)
