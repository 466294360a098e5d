"""Fitted models, null models and trees: small dense problems inside a group, replicates spread by Spark."""

from __future__ import annotations

import hashlib
import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainloom.operators.centrality import _matrix, communities
from strainloom.operators.graph import residual_triangles
from strainloom.session import cut


def fit_glm(rows: DataFrame, response: str, terms: list[str], family: str, weight: str | None = None, steps: int = 25) -> list[tuple[str, float, float, float, float]]:
    """[(term, estimate, se, z, p)] of a binomial (logit) or poisson (log) model by iteratively reweighted least squares.

    Each step is one Spark aggregate of the normal equations (terms squared sums), so no row leaves its task; a step that
    lowers the likelihood is halved. Rows with a null in a used column are left out; a singular or diverging fit raises
    ValueError.
    """
    names = ["intercept", *terms]
    w0 = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = rows.select(F.col(response).cast("double").alias("y"), w0.alias("w"), F.lit(1.0).alias("x0"), *[F.col(t).cast("double").alias(f"x{i + 1}") for i, t in enumerate(terms)]).dropna()
    data = cut(data)
    beta = np.zeros(len(names))
    if family == "poisson":
        mean = data.agg(F.sum(F.col("y") * F.col("w")) / F.sum("w")).first()[0]
        beta[0] = math.log(mean) if mean and mean > 0 else 0.0
    best, reached, left = beta, -math.inf, steps
    while left:
        eta = sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta)) if family == "binomial" else F.exp(F.least(eta, F.lit(50.0)))
        var = mu * (1 - mu) if family == "binomial" else mu
        log_norm = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))) if family == "binomial" else mu
        k = len(names)
        got = data.agg(F.sum(F.col("w") * (F.col("y") * eta - log_norm)).alias("l"), *[F.sum(F.col("w") * var * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col("w") * (F.col("y") - mu) * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)]).first()
        if got["g0"] is None:
            raise ValueError("no rows to fit")
        if not got["l"] >= reached - 1e-9 * abs(reached) and np.abs(beta - best).max() > 1e-10:
            beta = best + (beta - best) / 2
            continue
        best, reached, left = beta, got["l"], left - 1
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        try:
            step = np.linalg.solve(h, np.array([got[f"g{i}"] for i in range(k)]))
        except np.linalg.LinAlgError as e:
            raise ValueError("singular fit") from e
        beta = beta + step
        if not np.isfinite(beta).all() or np.abs(beta).max() > 1e3:
            raise ValueError("the fit diverges")
        if np.abs(step).max() < 1e-10:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    normal = NormalDist()
    return [(n, float(b), float(s), float(b / s), 2 * (1 - normal.cdf(abs(b / s)))) for n, b, s in zip(names, beta, se)]


def _digamma(x: Column) -> Column:
    """Digamma for x > 0: moved up by 6, then the asymptotic series."""
    y = x + 6
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4.0))) - 1 / (252 * F.pow(y, F.lit(6.0))) - sum((1 / (x + i) for i in range(6)), F.lit(0.0))


def _trigamma(x: Column) -> Column:
    y = x + 6
    return 1 / y + 1 / (2 * y * y) + 1 / (6 * F.pow(y, F.lit(3.0))) - 1 / (30 * F.pow(y, F.lit(5.0))) + 1 / (42 * F.pow(y, F.lit(7.0))) + sum((1 / ((x + i) * (x + i)) for i in range(6)), F.lit(0.0))


#: A dispersion alpha up to this is none; the fit goes no further down than LEAST in log alpha.
POISSON, LEAST = 1e-6, -14.0


def fit_negative_binomial(rows: DataFrame, response: str, terms: list[str], steps: int = 60) -> tuple[dict[str, float], float]:
    """(coefficients, alpha) of the log-linear negative-binomial model with variance mu + alpha mu^2, by maximum
    likelihood: Newton steps of the coefficients and of log alpha together, each one Spark aggregate.

    Rows with a null in a used column are left out. Where the counts are not overdispersed alpha goes to 0, the Poisson
    limit. A singular or diverging fit raises ValueError.
    """
    names = ["intercept", *terms]
    data = cut(rows.select(F.col(response).cast("double").alias("y"), F.lit(1.0).alias("x0"), *[F.col(t).cast("double").alias(f"x{i + 1}") for i, t in enumerate(terms)]).dropna())
    start = fit_glm(rows, response, terms, "poisson")
    beta, theta, k = np.array([e for _, e, *_ in start]), math.log(0.5), len(names)
    for _ in range(steps):
        r = F.lit(math.exp(-theta))
        mu = F.exp(F.least(sum((F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.lit(0.0)), F.lit(50.0)))
        y = F.col("y")
        w, slope = mu * r / (r + mu), (y - mu) * r / (r + mu)
        g = _digamma(y + r) - _digamma(r) + F.log(r / (r + mu)) + 1 - (y + r) / (r + mu)
        h = _trigamma(r) * -1 + _trigamma(y + r) + 1 / r - 2 / (r + mu) + (y + r) / ((r + mu) * (r + mu))
        got = data.agg(*[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(slope * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)], F.sum(g).alias("g"), F.sum(h).alias("h")).first()
        if got["g0"] is None:
            raise ValueError("no rows to fit")
        matrix = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        try:
            step = np.linalg.solve(matrix, np.array([got[f"g{i}"] for i in range(k)]))
        except np.linalg.LinAlgError as e:
            raise ValueError("singular fit") from e
        size = math.exp(-theta)
        first, second = -size * got["g"], size * got["g"] + size * size * got["h"]
        move = -first / second if second < 0 else math.copysign(1.0, first)
        move = max(-1.0, min(1.0, move))
        beta, theta = beta + np.clip(step, -5, 5), max(LEAST, theta + move)
        if not np.isfinite(beta).all() or np.abs(beta).max() > 1e3:
            raise ValueError("the fit diverges")
        if np.abs(step).max() < 1e-9 and (abs(move) < 1e-8 or theta <= LEAST):
            break
    return dict(zip(names, map(float, beta))), (math.exp(theta) if math.exp(theta) > POISSON else 0.0)


def size_adjusted(rows: DataFrame, response: str, terms: list[str]) -> DataFrame:
    """rows + (expected, excess, residual): Pearson residual (y - mu) / sqrt(mu + alpha mu^2) of a log-linear
    negative-binomial fit."""
    fit, alpha = fit_negative_binomial(rows, response, terms)
    eta = sum((F.lit(fit[t]) * F.col(t).cast("double") for t in terms), F.lit(fit["intercept"]))
    with_mean = rows.withColumn("expected", F.exp(eta))
    mu = F.col("expected")
    return with_mean.withColumn("excess", F.col(response) - mu).withColumn("residual", (F.col(response) - mu) / F.sqrt(mu + alpha * mu * mu))


def rewired(w: np.ndarray, seed: int, swaps: int = 5) -> np.ndarray:
    """A graph with the same degrees and the same multiset of weights: edge swaps, then shuffled weights."""
    rng = random.Random(seed)
    edges = [tuple(e) for e in np.argwhere(np.triu(w, 1) > 0).tolist()]
    weights = [w[e] for e in edges]
    have, target, tries = set(edges), swaps * len(edges), 0
    while target > 0 and len(edges) > 1 and tries < 100 * swaps * len(edges):
        tries += 1
        i, j = rng.sample(range(len(edges)), 2)
        (a, b), (c, d) = edges[i], edges[j]
        if rng.random() < 0.5:
            c, d = d, c
        new = [tuple(sorted((a, d))), tuple(sorted((c, b)))]
        if len({a, b, c, d}) == 4 and not have & set(new):
            have -= {edges[i], edges[j]}
            have |= set(new)
            edges[i], edges[j] = new
            target -= 1
    rng.shuffle(weights)
    out = np.zeros_like(w)
    for (a, b), x in zip(edges, weights):
        out[a, b] = out[b, a] = x
    return out


def modularity_of(w: np.ndarray, label: np.ndarray) -> float:
    m2 = w.sum()
    if m2 == 0:
        return 0.0
    same = label[:, None] == label[None, :]
    k = w.sum(1)
    return float(((w - np.outer(k, k) / m2) * same).sum() / m2)


def modularity_significance(edges: DataFrame, nodes: list[str], n_null: int, seed: int = 186) -> DataFrame:
    """(observed, null_mean, null_sd, z, p_upper) of the modularity found on the graph against rewired graphs.

    Null graphs are independent tasks; the edge list, one row a pair of nodes, goes with each.
    """
    packed = edges.agg(F.collect_list(F.struct("u", "v", "weight")).alias("edges"))
    spread = edges.sparkSession.range(n_null + 1).repartition(min(n_null + 1, 64)).crossJoin(F.broadcast(packed))

    def run(batches):
        for pdf in batches:
            out = []
            for k, es in zip(pdf.id, pdf.edges):
                w = _matrix(pd.DataFrame([(e["u"], e["v"], e["weight"]) for e in es], columns=["u", "v", "weight"]), nodes)
                if k:
                    w = rewired(w, seed + int(k))
                out.append((k, modularity_of(w, communities(w, seed))))
            yield pd.DataFrame(out, columns=["id", "q"])

    q = spread.mapInPandas(run, "id long, q double")
    null = F.when(F.col("id") > 0, F.col("q"))
    seen = F.max(F.when(F.col("id") == 0, F.col("q")))
    got = q.agg(seen.alias("observed"), F.avg(null).alias("m"), F.stddev_samp(null).alias("sd"), F.sort_array(F.collect_list(null)).alias("all"))
    above = F.size(F.filter("all", lambda v: v >= F.col("observed")))
    return got.select(F.round("observed", 6).alias("observed"), F.round("m", 6).alias("null_mean"), F.round("sd", 6).alias("null_sd"), F.round(F.try_divide(F.col("observed") - F.col("m"), F.col("sd")), 6).alias("z"), F.round((above + 1) / (F.size("all") + 1), 6).alias("p_upper"))


def neighbour_joining(d: np.ndarray, names: list[str]) -> list[tuple[str, str, float]]:
    """[(node, parent, length)] of the neighbour-joining tree; inner nodes are named n0, n1, ...; the last is the root."""
    d, active, out, made = d.astype(float).copy(), list(names), [], 0
    while len(active) > 2:
        n = len(active)
        r = d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(np.unravel_index(np.argmin(q), q.shape))
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        name = f"n{made}"
        made += 1
        out += [(active[i], name, max(0.0, li)), (active[j], name, max(0.0, d[i, j] - li))]
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.vstack([np.hstack([d[np.ix_(keep, keep)], row[keep][:, None]]), np.hstack([row[keep], [0.0]])])
        active = [active[k] for k in keep] + [name]
    if len(active) == 2:
        out += [(active[0], "root", d[0, 1] / 2), (active[1], "root", d[0, 1] / 2)]
    return out


def tree_of(dist: DataFrame) -> DataFrame:
    """(node, parent, length) from dist(c1, c2, d). A tree needs its whole matrix, so it suits tables of clusters."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.c1) | set(pdf.c2))
        at = {n: i for i, n in enumerate(names)}
        d = np.zeros((len(names), len(names)))
        d[pdf.c1.map(at), pdf.c2.map(at)] = pdf.d
        d = (d + d.T) / 2
        np.fill_diagonal(d, 0)
        return pd.DataFrame(neighbour_joining(d, [str(n) for n in names]), columns=["node", "parent", "length"])

    return dist.groupBy(F.lit(1).alias("one")).applyInPandas(run, "node string, parent string, length double")


def faith_diversity(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, faith_pd): summed branch lengths between a node's clusters and the root, each branch once.

    Branches are climbed level by level with joins; clusters that are not in the tree add nothing.
    """
    edges = F.broadcast(tree.select(F.col("node").alias("at"), "parent", "length"))  # at most two rows a cluster of the matrix
    now = counts.select("node", F.col("cluster").cast("string").alias("at")).distinct()
    seen = None
    while True:
        step = cut(now.join(edges, "at").select("node", "at", "parent", "length"))
        if step.isEmpty():
            break
        seen = step.select("node", "at", "length") if seen is None else seen.unionByName(step.select("node", "at", "length"))
        now = step.select("node", F.col("parent").alias("at")).distinct()
    if seen is None:
        return counts.select("node").distinct().withColumn("faith_pd", F.lit(0.0))
    return counts.select("node").distinct().join(seen.distinct().groupBy("node").agg(F.sum("length").alias("s")), "node", "left").select("node", F.round(F.coalesce("s", F.lit(0.0)), 6).alias("faith_pd"))


def node_seed(base: int, node: str) -> int:
    """A seed of its own for each node's stream of draws."""
    return int.from_bytes(hashlib.blake2b(f"{base}::{node}".encode(), digest_size=8).digest(), "big") % (2**32 - 1)


def multinomial(counts: DataFrame, by: list[str], replicates: int, seed: int = 186, frac: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """by + (replicate, node, cluster, n): each node's count vector drawn anew (multinomial), with a part of its total
    between the two of frac. A group holds one node of one `by`: a row a cluster; replicates leave it one at a time."""
    if replicates < 1 or not 0 < frac[0] <= frac[1]:
        raise ValueError("replicates must be at least 1 and 0 < frac[0] <= frac[1]")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        rng, p = np.random.default_rng(node_seed(seed, "::".join(map(str, key)))), pdf.n.to_numpy(float)
        draws = np.array([rng.multinomial(max(1, round(p.sum() * rng.uniform(*frac))), p / p.sum()) for _ in range(replicates)])
        r, c = np.nonzero(draws)
        fixed = {name: pdf[name].iloc[0] for name in [*by, "node"]}
        return pd.DataFrame({**{b: fixed[b] for b in by}, "replicate": r.astype("int32"), "node": fixed["node"], "cluster": pdf.cluster.to_numpy()[c], "n": draws[r, c]})

    kinds = "".join(f"{b} {counts.schema[b].dataType.simpleString()}, " for b in by)
    return counts.groupBy(*by, "node").applyInPandas(run, f"{kinds}replicate int, node string, cluster {counts.schema['cluster'].dataType.simpleString()}, n long")


def triangle_stability(counts: DataFrame, triangles: DataFrame, n_boot: int, seed: int = 186, frac: tuple[float, float] = (0.7, 1.2)) -> DataFrame:
    """(a, b, c, source, n_valid, n_invalid, selected_rate, supported_rate, delta_mean, delta_lo, delta_hi): how often each candidate of each
    triangle comes first, and is supported, over resampled counts. All triangles are judged in every replicate by
    the closed form, in one plan; replicates where a cosine is undefined count as draws without a result."""
    drawn = cut(multinomial(counts, [], n_boot, seed, frac))
    judged = residual_triangles(drawn, triangles.select("a", "b", "c"), by=("replicate",))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    valid = F.count(F.lit(1))
    return judged.groupBy("a", "b", "c", "source").agg(valid.alias("n_valid"), (F.lit(n_boot) - valid).alias("n_invalid"), share(F.col("delta_rank") == 1).alias("selected_rate"), share(F.col("supported")).alias("supported_rate"), F.round(F.avg("delta"), 6).alias("delta_mean"), F.round(F.percentile("delta", 0.025), 6).alias("delta_lo"), F.round(F.percentile("delta", 0.975), 6).alias("delta_hi"))
