"""Texts of varying length packed into containers of fixed capacity.

Documents are spread over shards of bounded size; inside a shard each goes into the tightest open container that has
no conflict, the sources with the most documents left first and of those the longest, so that no source is left over
when the containers are full. Open containers lie ordered by their free room, each with a bitmap of the sources
and one of the duplicate clusters in it; the search goes on to the next larger room until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents a shard should hold; its containers are filled independently of other shards.
SHARD = 8_000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, source_slack: float | None = None) -> list[int]:
    """Container of each item (sizes at most capacity), in the order given.

    Two items of one cluster (an id from 0; -1 for none) never share a container, nor do two of one source. With a
    `source_slack`, two of one source may share the tightest container where the tightest one that keeps them apart
    would be left with more free room than this share of the capacity, or is a new one.
    """
    rooms: list[tuple[int, int]] = []  # (free room, container), ordered
    in_source: list[int] = []
    in_cluster: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit, cluster_bit = 1 << source, 1 << cluster if cluster >= 0 else 0
        chosen = shared = -1
        k = bisect_left(rooms, (size, -1))
        while k < len(rooms):
            room, box = rooms[k]
            if not in_cluster[box] & cluster_bit:
                if not in_source[box] & source_bit:
                    chosen = k
                    break
                shared = k if shared < 0 else shared
            k += 1
        if source_slack is not None and shared >= 0 and (chosen < 0 or rooms[chosen][0] - size > source_slack * capacity):
            chosen = shared
        if chosen < 0:
            box, room = len(in_source), capacity
            in_source.append(0)
            in_cluster.append(0)
        else:
            room, box = rooms.pop(chosen)
        in_source[box] |= source_bit
        in_cluster[box] |= cluster_bit
        if room > size:
            insort(rooms, (room - size, box))
        out.append(box)
    return out


def pack_documents(sized: DataFrame, id_col: str, size_col: str, source: Column, cluster: Column, capacity: int, source_slack: float | None = None) -> DataFrame:
    """(id, piece, token_from, token_to, n_tokens, container, source_again): every document in containers of `capacity`
    tokens; source_again: its container held its source already (never without a `source_slack`, see best_fit).

    A document within the capacity is one piece; a longer one is cut into full pieces, each a container of its own,
    and a rest that is packed like others. Empty and null texts (size 0 or null) take no room and give no row.
    `cluster` names copies that must not meet in a container (null: none); null sources count as one source.
    Repeated ids are packed as separate documents. An empty table gives no rows. Hot sources and clusters are
    spread over the shards by a hash of the id, so no group holds them whole.
    """
    docs = sized.select(F.col(id_col).alias("id"), F.col(size_col).cast("int").alias("size"), F.coalesce(source, F.lit("")).alias("source"), F.xxhash64(cluster).alias("cluster"), cluster.isNotNull().alias("known")).where("size > 0")
    shards = max(1, -(-docs.count() // SHARD))
    shard = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int").alias("shard")
    cut_up = docs.select("*", shard, F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {capacity}").cast("int"))).alias("piece"))
    cut_up = cut_up.withColumn("token_from", F.col("piece") * capacity).withColumn("token_to", F.least(F.col("size"), (F.col("piece") + 1) * capacity))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(n_tokens=group.token_to - group.token_from).sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        if source_slack is None:
            group = group.assign(left=group.groupby("source").cumcount(ascending=False)).sort_values("left", ascending=False, kind="stable")
        sources = pd.factorize(group.source)[0].tolist()
        codes = pd.factorize(group.cluster)[0]
        twice = pd.Series(codes).duplicated(keep=False).to_numpy() & group.known.to_numpy()
        clusters = [-1] * len(group)
        for place, code in zip(twice.nonzero()[0], pd.factorize(codes[twice])[0]):  # only clusters met twice can conflict
            clusters[place] = int(code)
        box = best_fit(group.n_tokens.tolist(), sources, clusters, capacity, source_slack)
        group["container"] = [f"{s}-{b}" for s, b in zip(group.shard, box)]
        group["source_again"] = group.duplicated(["container", "source"])
        return group[["id", "piece", "token_from", "token_to", "n_tokens", "container", "source_again"]]

    packed = cut_up.groupBy("shard").applyInPandas(fill, f"id {docs.schema['id'].dataType.simpleString()}, piece int, token_from int, token_to int, n_tokens int, container string, source_again boolean")
    return packed.withColumnRenamed("id", id_col)
