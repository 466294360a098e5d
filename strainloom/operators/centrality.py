"""Centralities, communities and roles of small graphs, one replicate in a group.

A graph has as many vertices as there are nodes (tens to hundreds), so replicates are spread over the cluster and
the short kernels below run inside a group; everything across replicates is Spark aggregation.
"""

from __future__ import annotations

import heapq
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["degree", "strength", "clustering", "eigenvector", "betweenness", "closeness"]


def _matrix(edges: pd.DataFrame, nodes: list[str]) -> np.ndarray:
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for u, v, x in zip(edges.u, edges.v, edges.weight):
        w[at[u], at[v]] = w[at[v], at[u]] = x
    return w


def eigenvector(w: np.ndarray) -> np.ndarray:
    """Power iteration on A + I from equal entries; NaN when it does not settle."""
    n = len(w)
    x = np.full(n, 1.0 / n)
    for _ in range(500):
        y = x + w @ x
        y /= np.linalg.norm(y) or 1.0
        if np.abs(y - x).sum() < n * 1e-6:
            return y
        x = y
    return np.full(n, np.nan)


def shortest_paths(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(betweenness, closeness) on distances 1 / weight: pair dependencies over (n-1)(n-2), and the share reached
    times the inverse mean distance."""
    n = len(w)
    between, close = np.zeros(n), np.zeros(n)
    around = [np.flatnonzero(row) for row in w]
    for s in range(n):
        dist, paths, before = {s: 0.0}, np.zeros(n), [[] for _ in range(n)]
        paths[s] = 1
        done, order, heap = set(), [], [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v in around[u]:
                nd = d + 1.0 / w[u, v]
                old = dist.get(v, np.inf)
                if nd < old - 1e-12:
                    dist[v], paths[v], before[v] = nd, paths[u], [u]
                    heapq.heappush(heap, (nd, v))
                elif abs(nd - old) <= 1e-12 and v not in done:
                    paths[v] += paths[u]
                    before[v].append(u)
        share = np.zeros(n)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                between[v] += share[v]
        reach, total = len(order), sum(dist[v] for v in order)
        if reach > 1 and n > 1:
            close[s] = (reach - 1) / total * (reach - 1) / (n - 1)
    return (between / ((n - 1) * (n - 2)) if n > 2 else between), close


def metrics_of(edges: pd.DataFrame, nodes: list[str]) -> pd.DataFrame:
    w = _matrix(edges, nodes)
    n = len(nodes)
    adj = w > 0
    k = adj.sum(1)
    scaled = np.cbrt(w / (w.max() or 1.0))
    tri = np.einsum("ij,jk,ki->i", scaled, scaled, scaled)
    between, close = shortest_paths(w)
    return pd.DataFrame({
        "node": nodes, "degree": k / max(1, n - 1), "strength": w.sum(1) / (w.sum(1).max() or 1.0),
        "clustering": np.where(k > 1, tri / np.maximum(1, k * (k - 1)), 0.0), "eigenvector": eigenvector(w), "betweenness": between, "closeness": close,
    })


def communities(w: np.ndarray, seed: int = 186) -> np.ndarray:
    """Greedy modularity communities: vertices move to the neighbouring community with the largest gain, communities
    become vertices, until nothing moves. Isolated vertices stay alone; the same seed gives the same result."""
    rng, label, a = random.Random(seed), np.arange(len(w)), w.copy()
    while True:
        n, m2 = len(a), a.sum()
        if m2 == 0:
            return label
        k, own, moved, again = a.sum(1), np.arange(n), False, True
        total = k.copy()
        while again:
            again = False
            for v in rng.sample(range(n), n):
                home = own[v]
                total[home] -= k[v]
                near = np.flatnonzero(a[v])
                near = near[near != v]
                gain = {home: a[v, (own == home) & (np.arange(n) != v)].sum() - k[v] * total[home] / m2}
                for c in np.unique(own[near]):
                    if c != home:
                        gain[c] = a[v, own == c].sum() - k[v] * total[c] / m2
                best = max(gain, key=lambda c: (gain[c], c == home, -c))
                if gain[best] > gain[home] + 1e-12:
                    own[v], again, moved = best, True, True
                total[own[v]] += k[v]
        names, own = np.unique(own, return_inverse=True)
        label = own[label]
        if not moved:
            return label
        hot = np.zeros((n, len(names)))
        hot[np.arange(n), own] = 1
        a = hot.T @ a @ hot


def average_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Labels of average-linkage clustering cut at a distance (inclusive)."""
    n = len(distance)
    groups = {i: [i] for i in range(n)}
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if d[i, j] > cut:
            break
        ni, nj = len(groups[i]), len(groups[j])
        row = (ni * d[i] + nj * d[j]) / (ni + nj)
        d[i], d[:, i], d[i, i] = row, row, np.inf
        d[j], d[:, j] = np.inf, np.inf
        groups[i] += groups.pop(j)
    label = np.empty(n, int)
    for c, members in enumerate(sorted(groups.values(), key=min)):
        label[members] = c
    return label


def replicate_metrics(edges: DataFrame, nodes: list[str] | None, by: str = "replicate", weighted: bool = True, normalised: bool = True) -> DataFrame:
    """(by, node, six metrics) of each replicate's graph edges(by, u, v, weight) on the given vertices (None: those with
    an edge). Not weighted: every weight is 1; not normalised: degree and strength as counts and sums. Replicates
    without edges give no rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = nodes if nodes is not None else sorted(set(pdf.u) | set(pdf.v))
        got = metrics_of(pdf if weighted else pdf.assign(weight=1.0), names).assign(**{by: pdf[by].iloc[0]})
        if not normalised:
            w = _matrix(pdf if weighted else pdf.assign(weight=1.0), names)
            got = got.assign(degree=(w > 0).sum(1).astype(float), strength=w.sum(1))
        return got[[by, "node", *METRICS]]

    return edges.groupBy(by).applyInPandas(run, f"{by} {edges.schema[by].dataType.simpleString()}, node string, " + ", ".join(f"{m} double" for m in METRICS))


def replicate_communities(edges: DataFrame, nodes: list[str], by: str = "replicate", seed: int = 186) -> DataFrame:
    """(by, node, community) of each replicate; isolated vertices keep a community of their own."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: pdf[by].iloc[0], "node": nodes, "community": communities(_matrix(pdf, nodes), seed)})

    return edges.groupBy(by).applyInPandas(run, f"{by} {edges.schema[by].dataType.simpleString()}, node string, community int")


def coassignment(partitions: DataFrame, by: str = "replicate", replicates: int | None = None) -> DataFrame:
    """(u, v, support): share of the replicates in which two nodes share a community, u < v; of those asked for where
    their number is given, as one without edges has no partition and joins nothing."""
    b = F.broadcast(partitions.agg((F.countDistinct(by) if replicates is None else F.lit(replicates)).alias("b")))
    x, y = partitions.select(by, "community", F.col("node").alias("u")), partitions.select(by, "community", F.col("node").alias("v"))
    return x.join(y, [by, "community"]).where("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).crossJoin(b).select("u", "v", F.round(F.col("n") / F.col("b"), 6).alias("support"))


def consensus_partition(support: DataFrame, nodes: list[str], threshold: float) -> DataFrame:
    """(node, community): average linkage on 1 - support, cut at 1 - threshold. The table has a row a pair of nodes."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _matrix(pdf.rename(columns={"support": "weight"}), nodes)
        np.fill_diagonal(w, 1.0)
        return pd.DataFrame({"node": nodes, "community": average_linkage(1 - w, 1 - threshold)})

    return support.groupBy(F.lit(1).alias("one")).applyInPandas(run, "node string, community int")


#: The role of a node that has no edge in a graph.
NOT_RETAINED = "not retained"


def roles(metrics: DataFrame, by: list[str], q: float = 0.75) -> DataFrame:
    """metrics + role, by whether betweenness and eigenvector reach their q-quantile among the retained nodes of a graph,
    those with an edge; the others are not retained. A metric that is not a finite number raises an error."""
    kept = metrics.where("degree > 0")
    limits = kept.groupBy(*by).agg(F.percentile("betweenness", q).alias("qb"), F.percentile("eigenvector", q).alias("qe"))
    joined = metrics.join(F.broadcast(limits), by, "left") if by else metrics.crossJoin(F.broadcast(limits))
    odd = reduce(lambda a, b: a | b, [F.col(m).isNull() | F.isnan(m) | (F.abs(m) == float("inf")) for m in ("betweenness", "eigenvector")])
    high_b, high_e = F.col("betweenness") >= F.col("qb"), F.col("eigenvector") >= F.col("qe")
    role = F.when(F.col("degree") <= 0, NOT_RETAINED).when(odd, F.raise_error(F.lit("a metric is not finite"))).when(high_b & high_e, "global connector").when(high_b, "broker").when(high_e, "core influencer").otherwise("peripheral")
    return joined.withColumn("role", role).drop("qb", "qe")


def all_roles(labelled: DataFrame, replicates: int, nodes: DataFrame) -> DataFrame:
    """(replicate, node, role) for replicates 0.. and every node of nodes(node): those without a row are not retained."""
    grid = labelled.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(nodes.select("node")))  # a row a node
    return grid.join(labelled.select("replicate", "node", "role"), ["replicate", "node"], "left").fillna(NOT_RETAINED, ["role"])


def role_frequencies(labelled: DataFrame) -> DataFrame:
    """(node, role, percent, mcse) over the replicates of (replicate, node, role); with all_roles a node's rows sum to
    100."""
    b = F.broadcast(labelled.agg(F.countDistinct("replicate").alias("b")))
    p = labelled.groupBy("node", "role").agg(F.count(F.lit(1)).alias("n")).crossJoin(b).withColumn("p", F.col("n") / F.col("b"))
    return p.select("node", "role", F.round(100 * F.col("p"), 6).alias("percent"), F.round(100 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("b")), 6).alias("mcse"))


def role_recovery(labelled: DataFrame, baseline: DataFrame) -> DataFrame:
    """(node, baseline_role, recovery_percent, retention_percent): shares of the replicates in which a node has its
    baseline role, and in which it is retained."""
    base = baseline.select("node", F.col("role").alias("baseline_role"))
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    return labelled.join(F.broadcast(base), "node").groupBy("node", "baseline_role").agg(share(F.col("role") == F.col("baseline_role")).alias("recovery_percent"), share(F.col("role") != NOT_RETAINED).alias("retention_percent"))


def percentile_ranks(metrics: DataFrame, by: str = "replicate") -> DataFrame:
    """(by, node, metric, percentile): average rank of a node among the retained ones of a graph, in per cent."""
    long = metrics.where("degree > 0").select(by, "node", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))
    w = Window.partitionBy(by, "metric")
    rank = F.rank().over(w.orderBy("value")) + (F.count(F.lit(1)).over(Window.partitionBy(by, "metric", "value")) - 1) / 2
    return long.select(by, "node", "metric", F.round(100 * rank / F.count(F.lit(1)).over(w), 6).alias("percentile"))


def incomplete_replicates(labelled: DataFrame, replicates: int, n_nodes: int) -> DataFrame:
    """(replicate, n_rows, n_nodes) of the replicates 0.. that lack a node or hold one twice."""
    seen = labelled.groupBy("replicate").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("node").alias("n_nodes"))
    asked = labelled.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    return asked.join(seen, "replicate", "full").fillna(0, ["n_rows", "n_nodes"]).where((F.col("n_rows") != n_nodes) | (F.col("n_nodes") != n_nodes) | (F.col("replicate") >= replicates))


def centrality_summary(metrics: DataFrame) -> DataFrame:
    """(node, metric, retained, lower, median, upper): 2.5, 50 and 97.5 percentiles over the replicates."""
    long = metrics.select("node", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])))
    return long.groupBy("node", "metric").agg(F.count("value").alias("retained"), *[F.round(F.percentile("value", q), 6).alias(n) for n, q in (("lower", 0.025), ("median", 0.5), ("upper", 0.975))])


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, pearson, spearman, kendall) for each pair of columns over rows without a null in any of them.

    Kendall compares all pairs of rows, so use it on tables of nodes.
    """
    kept = rows.select(*columns).dropna().withColumn("__i", F.monotonically_increasing_id())
    for c in columns:
        peers = Window.partitionBy(c)
        kept = kept.withColumn(f"__{c}", F.rank().over(Window.orderBy(c)) + (F.count(F.lit(1)).over(peers) - 1) / 2)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    flat = kept.agg(*[x for a, b in pairs for x in (F.round(F.corr(a, b), 6).alias(f"p{a}|{b}"), F.round(F.corr(f"__{a}", f"__{b}"), 6).alias(f"s{a}|{b}"))])
    left, right = kept.select(F.col("__i").alias("i"), *[F.col(c).alias(f"l{c}") for c in columns]), kept.select(F.col("__i").alias("j"), *[F.col(c).alias(f"r{c}") for c in columns])
    both = left.join(F.broadcast(right), F.col("i") < F.col("j"))
    sign = {c: F.signum(F.col(f"l{c}") - F.col(f"r{c}")) for c in columns}
    tau = both.agg(*[F.round(F.try_divide(F.sum(sign[a] * sign[b]), F.sqrt(F.sum(F.abs(sign[a])) * F.sum(F.abs(sign[b])))), 6).alias(f"k{a}|{b}") for a, b in pairs])
    wide = flat.crossJoin(tau)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`p{a}|{b}`").alias("pearson"), F.col(f"`s{a}|{b}`").alias("spearman"), F.col(f"`k{a}|{b}`").alias("kendall")) for a, b in pairs])))
