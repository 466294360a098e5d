"""Draws that are the same under any partitioning and in any engine: uniforms from md5 of a text key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from the parts joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


#: Parts that a group is numbered in.
PARTS = 64


def numbered(rows: DataFrame, order: str, by: list[str], name: str, then: list[str] = []) -> DataFrame:
    """rows + name: the place of each row in its group by `order` (a number or text without nulls), then `then`, from 0.

    The group is cut into parts by ranges of a number or by the first two characters of a text; counts of the parts
    give the place where each begins, so only a part of a group is sorted in a task.
    """
    if isinstance(rows.schema[order].dataType, NumericType):
        span = F.broadcast(rows.agg(F.min(order).cast("double").alias("__lo"), (F.max(order).cast("double") + 1).alias("__hi")))  # one row
        parted = rows.crossJoin(span).withColumn("__part", F.expr(f"cast(width_bucket(cast(`{order}` as double), __lo, __hi, {PARTS}L) as string)")).drop("__lo", "__hi")
        parted = parted.withColumn("__part", F.lpad("__part", 4, "0"))
    else:
        parted = rows.withColumn("__part", F.substring(order, 1, 2))
    sizes = parted.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(*by, "__part", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = parted.join(before, [*by, "__part"])
    at = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(order, *then)) - 1
    return placed.withColumn(name, F.col("__before") + at).drop("__part", "__before")


def draw_with_replacement(rows: DataFrame, id_col: str, group: str, replicates: int, seed: int, size: int | str | None = None) -> DataFrame:
    """rows.columns + [replicate]: in each replicate every group is drawn as often as it has rows; with a number as
    `size` that often, with "least" as often as the smallest group has rows.

    Each row's place in its group is known; the draw of place i of a replicate is a hash, so the rows meet by an
    equi-join on (group, place). Ids without nulls; rows with a null group drop out.
    """
    placed = numbered(rows.where(F.col(group).isNotNull()), id_col, [group], "__place")
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    draws = F.col("__size") if size is None else F.lit(size) if isinstance(size, int) else F.col("__least")
    if size == "least":
        sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.min("__size").alias("__least"))))
    # a draw for each row of the group (so a hot group's draws are spread as its rows are), or for each asked
    if size is None:
        each = placed.select(group, "__place").join(sizes, group)
    else:
        each = sizes.withColumn("__place", F.explode(F.sequence(F.lit(0).cast("long"), draws.cast("long") - 1)))
    each = each.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    each = each.select(group, "replicate", F.floor(uniform(seed, F.col("replicate"), F.col(group), F.col("__place")) * F.col("__size")).alias("__place"))
    # Spark takes an exploded table for as small as it was before, and would broadcast all draws
    return each.hint("merge").join(placed, [group, "__place"]).drop("__place")


def draw_without_replacement(rows: DataFrame, id_col: str, group: str, n: int, replicates: int, seed: int) -> DataFrame:
    """rows.columns + [replicate]: n rows of each group in each replicate, those with the smallest keys; Spark keeps at most n
    of a group and replicate in a task before it shuffles them."""
    spread = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = Window.partitionBy(group, "replicate").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(id_col).cast("string"))), id_col)
    return spread.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def folds(rows: DataFrame, id_col: str, label: str, k: int, seed: int) -> DataFrame:
    """rows + fold: k folds that keep the shares of the labels."""
    w = Window.partitionBy(label).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), id_col)
    return rows.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))
