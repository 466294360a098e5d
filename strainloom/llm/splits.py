"""Splits that keep related records together.

Records and the keys they share form a graph. Random-mate contraction finds its components: in each round every
vertex throws a coin, and a vertex with tails collapses into a neighbour with heads; joins rewrite the edges until
none is left. The mappings of the rounds are unwound from the last to the first. Components are then split by
cumulative weight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strainloom.operators.skew import skew_join
from strainloom.session import cut

#: Rounds are given up beyond this; each at least halves the expected number of edges of a matching.
MAX_ROUNDS = 200
#: A key with more rows than HOT_ROWS is joined apart from the others, if it is one of the MOST_HOT with the most; any
#: other has less than 1 / MOST_HOT of all.
HOT_ROWS, MOST_HOT = 10_000, 200
#: Buckets over which cumulative weights are summed before they are summed inside a bucket.
WEIGHT_BUCKETS = 1024


def _coin(vertex: Column, turn: int) -> Column:
    return F.pmod(F.xxhash64(vertex, F.lit(turn)), F.lit(2)) == 1


def heavy_keys(counts: DataFrame, n_col: str, key: Column) -> list[str]:
    """The keys, as text, of the at most MOST_HOT rows of a table of counts that are above HOT_ROWS."""
    top = counts.where(F.col(n_col) > HOT_ROWS).orderBy(F.desc(n_col)).limit(MOST_HOT)
    return [r[0] for r in top.select(key.cast("string")).collect()]


def components(edges: DataFrame, heads: Callable[[Column], Column] | None = None) -> DataFrame:
    """(vertex, label) for every vertex of the undirected edges (u, v): label names its component.

    u and v are longs; loops and repeated edges are allowed, rows with a null are ignored, no edges give no rows.
    `heads`, a condition on a vertex, replaces the coins of the first round where the graph is known to have two
    sides. A vertex with very many edges is no single task: its edges are combined before a shuffle, and joined by
    broadcast with what it collapses into.
    """
    clean = cut(edges.where("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    now = clean.where("u <> v")
    maps = []
    for turn in range(MAX_ROUNDS):
        both = now.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))))
        is_head = heads if heads is not None and turn == 0 else (lambda c: _coin(c, turn))
        mate = F.when(~is_head(F.col("a")) & is_head(F.col("b")), F.col("b"))
        seen = Observation()
        around = both.groupBy("a").agg(F.min(mate).alias("b"), F.count(F.lit(1)).alias("n"))  # combined before the shuffle
        around = cut(around.observe(seen, F.max("n").alias("most")))
        most = seen.get["most"]
        if not most:
            break
        heavy = heavy_keys(around, "n", F.col("a")) if most > HOT_ROWS else []
        step = around.where("b is not null").select("a", "b")
        maps.append((step, heavy))  # no vertex takes in more others than it has edges
        moved = skew_join(now, step.select(F.col("a").alias("u"), F.col("b").alias("nu")), ["u"], "left", heavy=heavy)
        moved = skew_join(moved, step.select(F.col("a").alias("v"), F.col("b").alias("nv")), ["v"], "left", heavy=heavy)
        moved = moved.select(F.coalesce("nu", "u").alias("x"), F.coalesce("nv", "v").alias("y")).where("x <> y")
        now = cut(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    else:
        raise RuntimeError("contraction did not end")
    labels = None
    for turn, (step, heavy) in enumerate(reversed(maps)):  # each table is met by those of the later rounds only, which shrink geometrically
        if labels is None:
            labels = step.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
            continue
        through = skew_join(step, labels.select(F.col("vertex").alias("b"), F.col("label").alias("end")), ["b"], "left", heavy=heavy).select(F.col("a").alias("vertex"), F.coalesce("end", "b").alias("label"))
        labels = through.unionByName(labels)
        if turn % 3 == 0:  # a short plan between written tables
            labels = cut(labels)
    if labels is not None:
        labels = cut(labels)
    vertices = clean.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    if labels is None:
        return vertices.select("vertex", F.col("vertex").alias("label"))
    return vertices.join(labels, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label"))


def related_groups(records: DataFrame, id_col: str, ties: DataFrame) -> DataFrame:
    """(id, group_id) for every record, tied or not; group_id is the smallest id of its group.

    `ties` holds (id, kind, key): records with the same kind and key belong together; rows with a null key tie
    nothing. A record without ties is its own group. Ids are longs and unique. A key that a third of the records
    share costs one edge for each record, never a pair of records.
    """
    known = ties.where(F.col("key").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "kind", "key")
    # the hub of a key is a vertex of its own, named by the smallest id that has it: 8 kinds fit beside the ids
    hubs = known.groupBy("kind", "key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = cut(hubs)
    heavy = heavy_keys(hubs, "n", F.to_json(F.struct("kind", "key")))
    edges = skew_join(known, hubs.drop("n"), ["kind", "key"], heavy=heavy).select((F.col("id") * 8).alias("u"), (F.col("least") * 8 + F.col("kind")).alias("v"))
    found = components(edges, lambda vertex: vertex % 8 != 0).where("vertex % 8 = 0").select(F.expr("vertex div 8").alias(id_col), "label")
    found = cut(found)
    least = cut(found.groupBy("label").agg(F.min(id_col).alias("group_id"), F.count(F.lit(1)).alias("n")))
    grouped = skew_join(found, least.drop("n"), ["label"], heavy=heavy_keys(least, "n", F.col("label"))).select(id_col, "group_id")
    return records.select(id_col).join(grouped, id_col, "left").select(id_col, F.coalesce("group_id", id_col).alias("group_id"))


def split_by_weight(groups: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(group_id, split_name) for groups (group_id, weight): splits get the shares in targets (split_name, target_share).

    Groups are laid end to end and cut at the cumulative shares, the largest split first. Groups heavier than a
    hundredth of the smallest split come first, by falling powers of two, so that they land in the largest split;
    all others follow in hashed order. The sums run over hash buckets, then inside a bucket; targets is small.
    """
    share = targets.where("target_share > 0")
    w = Window.orderBy(F.desc("target_share"), "split_name").rowsBetween(Window.unboundedPreceding, 0)
    ends = share.select("split_name", "target_share", F.sum("target_share").over(w).alias("upto"))
    by_end = Window.orderBy("upto", F.desc("target_share"), "split_name")
    # each split begins where the one before ends; the first and the last reach beyond 0 and the total
    cuts = ends.select("split_name", F.lag("upto", 1, -1.0).over(by_end).alias("frm"), F.when(F.lead("upto").over(by_end).isNull(), float("inf")).otherwise(F.col("upto")).alias("upto"))
    total_share, least = share.agg(F.sum("target_share"), F.min("target_share")).first()
    total = groups.agg(F.sum("weight")).first()[0] or 0
    limit = max(1.0, 0.01 * (least or 0.0) / (total_share or 1.0) * total)
    size = F.when(F.col("weight") > limit, F.floor(F.log2("weight")).cast("int")).otherwise(0)
    placed = groups.select("group_id", "weight", (-size).alias("size"), F.xxhash64("group_id", F.lit(seed)).alias("h"))
    placed = placed.withColumn("bucket", F.pmod("h", F.lit(WEIGHT_BUCKETS)).cast("int"))
    sums = placed.groupBy("size", "bucket").agg(F.sum("weight").alias("s"))  # at most 64 * WEIGHT_BUCKETS rows
    before = sums.select("size", "bucket", (F.sum("s").over(Window.orderBy("size", "bucket")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("all"))
    inside = Window.partitionBy("size", "bucket").orderBy("h", "group_id")
    at = placed.join(F.broadcast(before), ["size", "bucket"]).withColumn("at", (F.col("before") + F.sum("weight").over(inside) - F.col("weight") / 2) / F.col("all") * F.lit(total_share or 1.0))
    return at.join(F.broadcast(cuts), (F.col("at") > F.col("frm")) & (F.col("at") <= F.col("upto"))).select("group_id", "split_name")
