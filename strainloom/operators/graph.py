"""Graphs as edges(u, v, weight) with u < v beside vertices(node); graph tables are as small as the set of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainloom.operators.centrality import replicate_metrics
from strainloom.session import cut


def threshold_edges(sims: DataFrame, measure: str, threshold: float) -> DataFrame:
    """Edges where the similarity is above the threshold (strictly)."""
    return sims.where(F.col(measure) > threshold).select("u", "v", F.col(measure).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b"), "weight"), F.struct(F.col("v").alias("a"), F.col("u").alias("b"), "weight"))))


def degree_strength(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, strength): k / (n - 1) and the summed weight as a share of the largest; isolated nodes get 0."""
    n = F.broadcast(vertices.agg(F.count(F.lit(1)).alias("n")))
    sums = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("k"), F.sum("weight").alias("s"))
    all_of = vertices.join(sums, "node", "left").fillna(0, ["k", "s"]).crossJoin(n).withColumn("most", F.max("s").over(Window.partitionBy()))
    return all_of.select("node", F.round(F.when(F.col("n") > 1, F.col("k") / (F.col("n") - 1)).otherwise(0.0), 6).alias("degree"), F.round(F.coalesce(F.try_divide("s", "most"), F.lit(0.0)), 6).alias("strength"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c, w_ab, w_ac, w_bc): every triangle once, a < b < c."""
    x = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").alias("w_ab"))
    y = edges.select(F.col("u").alias("a"), F.col("v").alias("c"), F.col("weight").alias("w_ac"))
    z = edges.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("weight").alias("w_bc"))
    return x.join(y, "a").where("b < c").join(z, ["b", "c"]).select("a", "b", "c", "w_ab", "w_ac", "w_bc")


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, clustering): geometric-mean triangle weights over the pairs of neighbours; 0 below two neighbours."""
    most = F.broadcast(edges.agg(F.max("weight").alias("m")))
    t = triangles(edges).crossJoin(most).withColumn("g", F.pow(F.col("w_ab") * F.col("w_ac") * F.col("w_bc") / F.pow("m", F.lit(3.0)), F.lit(1.0 / 3)))
    by = t.select(F.explode(F.array("a", "b", "c")).alias("node"), "g").groupBy("node").agg(F.sum("g").alias("g"))
    k = both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    joined = vertices.join(k, "node", "left").join(by, "node", "left")
    return joined.select("node", F.round(F.when(F.col("k") >= 2, 2 * F.coalesce("g", F.lit(0.0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0), 6).alias("clustering"))


def connectivity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_isolated, n_connected, fraction_connected)."""
    touched = both_ways(edges).select(F.col("a").alias("node")).distinct().withColumn("t", F.lit(1))
    return vertices.join(touched, "node", "left").agg(F.count_if(F.col("t").isNull()).alias("n_isolated"), F.count("t").alias("n_connected"), F.round(F.count("t") / F.count(F.lit(1)), 6).alias("fraction_connected"))


def without_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The vertices that have an edge."""
    return vertices.join(both_ways(edges).select(F.col("a").alias("node")), "node", "left_semi")


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): weighted modularity of partition(node, community); 0 without edges."""
    p = partition.select("node", "community")
    joined = edges.join(p.withColumnsRenamed({"node": "u", "community": "cu"}), "u").join(p.withColumnsRenamed({"node": "v", "community": "cv"}), "v")
    inside = joined.where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.sum("weight").alias("l"))
    degree = joined.select(F.inline(F.array(F.struct(F.col("cu").alias("community"), "weight"), F.struct(F.col("cv").alias("community"), "weight")))).groupBy("community").agg(F.sum("weight").alias("d"))
    m = F.broadcast(edges.agg(F.sum("weight").alias("m")))
    return degree.join(inside, "community", "left").crossJoin(m).agg(F.round(F.coalesce(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))), F.lit(0.0)), 6).alias("modularity"))


def community_stats(edges: DataFrame, partition: DataFrame, low_density: float = 0.3) -> DataFrame:
    """(community, size, internal_density, conductance, low_density_flag, is_singleton)."""
    p = partition.select("node", "community")
    joined = edges.join(p.withColumnsRenamed({"node": "u", "community": "cu"}), "u").join(p.withColumnsRenamed({"node": "v", "community": "cv"}), "v")
    inside = joined.where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.sum("weight").alias("w"))
    outside = joined.where("cu <> cv").select(F.explode(F.array("cu", "cv")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("x"))
    sizes = p.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    got = sizes.join(inside, "community", "left").join(outside, "community", "left").fillna(0.0, ["w", "x"])
    density = F.when(F.col("size") > 1, F.col("w") / (F.col("size") * (F.col("size") - 1) / 2.0)).otherwise(0.0)
    return got.select("community", "size", F.round(density, 6).alias("internal_density"), F.round(F.coalesce(F.try_divide(F.col("x"), 2 * F.col("w") + F.col("x")), F.lit(0.0)), 6).alias("conductance"), (density < low_density).alias("low_density_flag"), (F.col("size") == 1).alias("is_singleton"))


def renumber(partition: DataFrame, anchors: list[str]) -> DataFrame:
    """(node, community_number): communities of the anchor nodes get 1..k (the first anchor wins), the others follow
    by falling size, then smallest name."""
    p = partition.select("node", "community")
    ranks = F.coalesce(*[F.when(F.col("node") == a, F.lit(i)) for i, a in enumerate(anchors)]) if anchors else F.lit(None).cast("int")
    got = p.groupBy("community").agg(F.min(ranks).alias("anchor"), F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    order = Window.orderBy(F.asc_nulls_last("anchor"), F.desc("size"), "least")
    numbered = got.select("community", F.row_number().over(order).alias("community_number"))
    return p.join(numbered, "community").select("node", "community_number")


def metagraph(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(cu, cv, weight, n_edges): summed weights and edge counts between communities, cu < cv."""
    p = partition.select("node", "community")
    joined = edges.join(p.withColumnsRenamed({"node": "u", "community": "x"}), "u").join(p.withColumnsRenamed({"node": "v", "community": "y"}), "v")
    return joined.where("x <> y").groupBy(F.least("x", "y").alias("cu"), F.greatest("x", "y").alias("cv")).agg(F.round(F.sum("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n_edges"))


def pair_dots(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by + (p, q, dot) for every ordered pair of nodes that share a cluster, a node with itself too."""
    a, b = counts.select(*by, "cluster", F.col("node").alias("p"), F.col("n").alias("np")), counts.select(*by, "cluster", F.col("node").alias("q"), F.col("n").alias("nq"))
    return a.join(b, [*by, "cluster"]).groupBy(*by, "p", "q").agg(F.sum(F.col("np") * F.col("nq")).cast("double").alias("dot"))


def residual_triangles(
    counts: DataFrame, tri: DataFrame, max_residual: float = 0.3, base_min_delta: float = 0.15, min_fraction: float = 0.5, min_gap: float = 0.1,
    by: tuple[str, ...] = (), require_size: bool = False, richness_top_n: int | None = None,
) -> DataFrame:
    """Three candidates for each triangle: is the similarity of two nodes explained by the third?

    The cosine of two count vectors before and after the third is projected out, in closed form from the dot
    products; candidates are ranked by the drop, the gap of best to second counts for rank 1. passes_size: the source
    has at least as many clusters as either of the two (asked for with require_size); source_rank: its place by
    clusters among all nodes, ties sharing one (at most richness_top_n where that is given). Rows whose cosine is
    undefined are left out. With `by` (replicates of counts) every triangle is judged in each of them.
    """
    dots = cut(pair_dots(counts, by))  # a row a pair of nodes, read six times
    rich = counts.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("clusters"))
    rich = cut(rich.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("clusters")))))
    named = F.array(*[F.struct(F.col(s).alias("source"), F.col(x).alias("x"), F.col(y).alias("y")) for s, x, y in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))])
    cand = tri.select("a", "b", "c", F.inline(named))
    cand = cand.join(dots.where(F.col("p") == F.col("q")).select(*by, F.col("p").alias("x"), F.col("dot").alias("xx")), "x")
    for name, p, q in (("yy", "y", "y"), ("ss", "source", "source"), ("xy", "x", "y"), ("xs", "x", "source"), ("ys", "y", "source")):
        d = dots.select(*by, F.col("p").alias(p), F.col("q").alias(q if q != p else "__q"), F.col("dot").alias(name))
        if p == q:
            d = d.where(F.col(p) == F.col("__q")).drop("__q")
        cand = cand.join(d, [*by, *dict.fromkeys((p, q))], "left")
    for role, name in (("source", "source_clusters"), ("x", "__cx"), ("y", "__cy")):
        kept = [F.col("rank").alias("source_rank")] if role == "source" else []
        cand = cand.join(rich.select(*by, F.col("node").alias(role), F.col("clusters").alias(name), *kept), [*by, role], "left")
    cand = cand.fillna(0.0, ["xy", "xs", "ys"])
    c0 = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    left, right = F.col("xx") - F.col("xs") * F.col("xs") / F.col("ss"), F.col("yy") - F.col("ys") * F.col("ys") / F.col("ss")
    c1 = F.when((left > 1e-9) & (right > 1e-9), (F.col("xy") - F.col("xs") * F.col("ys") / F.col("ss")) / F.sqrt(left * right))
    size = F.col("source_clusters") >= F.greatest("__cx", "__cy")
    got = cand.select(*by, "a", "b", "c", "source", F.round(c0 + 0.0, 6).alias("original"), F.round(c1 + 0.0, 6).alias("residual"), "source_clusters", "source_rank", size.alias("passes_size")).where("original is not null and residual is not null")
    got = got.withColumn("delta", F.round(F.col("original") - F.col("residual"), 6)).withColumn("fraction", F.when(F.col("original") > 0, F.round((F.col("original") - F.col("residual")) / F.col("original"), 9)))
    got = got.withColumn("required_delta", F.round(F.greatest(F.lit(base_min_delta), F.col("original") - max_residual), 6))
    w = Window.partitionBy(*by, "a", "b", "c").orderBy(F.desc("delta"), "source")
    got = got.withColumn("delta_rank", F.row_number().over(w)).withColumn("gap", F.when(F.col("delta_rank") == 1, F.round(F.col("delta") - F.lead("delta").over(w), 6)))
    passes = (F.col("residual") <= max_residual) & (F.col("delta") >= F.col("required_delta")) & (F.col("fraction") >= min_fraction)
    if require_size:
        passes = passes & F.col("passes_size")
    if richness_top_n is not None:
        passes = passes & (F.col("source_rank") <= richness_top_n)
    return got.withColumn("supported", F.coalesce((F.col("delta_rank") == 1) & passes & (F.col("gap") >= min_gap), F.lit(False)))


def disagreements(sims: DataFrame, measure: str, support: DataFrame, above: float = 0.35, below: float = 0.5) -> DataFrame:
    """(node, n_pairs): how often a node is in a pair that is similar but rarely assigned together."""
    joined = sims.select("u", "v", F.col(measure).alias("s")).join(support.select("u", "v", "support"), ["u", "v"], "left").fillna(0.0, ["support"])
    odd = joined.where((F.col("s") > above) & (F.col("support") < below))
    return odd.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_pairs"))


#: Shares of size, density, external weight and betweenness in the importance of a community.
IMPORTANCE = (0.4, 0.2, 0.2, 0.2)


def community_importance(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(community, size, internal_weight, density, external, conductance, betweenness, importance, role).

    The importance mixes shares of the largest size, density, external weight and betweenness in the graph of
    communities (distance 1 / weight). A community is dense or outward if its density or conductance reaches the median;
    dense ones are core, or hub if outward, others bridge if outward, else peripheral.
    """
    p = partition.select("node", "community")
    inside = edges.join(p.withColumnsRenamed({"node": "u", "community": "cu"}), "u").join(p.withColumnsRenamed({"node": "v", "community": "cv"}), "v").where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.sum("weight").alias("internal_weight"))
    stats = community_stats(edges, partition).select("community", "size", F.col("internal_density").alias("density"), "conductance")
    meta = metagraph(edges, partition)
    ends = meta.select(F.explode(F.array("cu", "cv")).alias("community"), "weight").groupBy("community").agg(F.sum("weight").alias("external"))
    # the graph of communities is far smaller than that of nodes: a row a pair of communities
    paths = replicate_metrics(meta.select(F.lit(0).alias("replicate"), F.col("cu").alias("u"), F.col("cv").alias("v"), "weight"), None).select(F.col("node").alias("community"), "betweenness")
    got = stats.join(inside, "community", "left").join(ends, "community", "left").join(paths, "community", "left").fillna(0.0, ["internal_weight", "external", "betweenness"])
    # isolated communities count as vertices of the normalised betweenness
    size_of = F.broadcast(got.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("external") > 0).alias("__m"), F.median("density").alias("md"), F.median("conductance").alias("mc")))
    got = got.crossJoin(size_of).withColumn("betweenness", F.coalesce(F.try_divide(F.col("betweenness") * (F.col("__m") - 1) * (F.col("__m") - 2), (F.col("__n") - 1) * (F.col("__n") - 2)), F.lit(0.0)))
    all_of = Window.partitionBy()
    shares = [F.coalesce(F.try_divide(F.col(c), F.max(c).over(all_of)), F.lit(0.0)) for c in ("size", "density", "external", "betweenness")]
    score = sum((w * c for w, c in zip(IMPORTANCE, shares)), F.lit(0.0))
    dense, far = F.col("density") >= F.col("md"), F.col("conductance") >= F.col("mc")
    role = F.when(dense & ~far, "core").when(dense, "hub").when(far, "bridge").otherwise("peripheral")
    return got.withColumn("importance", F.round(score, 6)).withColumn("role", role).select("community", "size", F.round("internal_weight", 6).alias("internal_weight"), "density", F.round("external", 6).alias("external"), "conductance", F.round("betweenness", 6).alias("betweenness"), "importance", "role")


def without_singletons(partition: DataFrame) -> DataFrame:
    """(node, community) of the communities of two nodes or more, numbered from 0 by their old names."""
    p = partition.select("node", "community")
    kept = p.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    numbers = kept.select("community", (F.row_number().over(Window.orderBy(F.col("community").cast("string"))) - 1).alias("number"))  # a row a community
    return p.join(numbers, "community").select("node", F.col("number").alias("community"))


def removal_stats(vertices: DataFrame, edges: DataFrame, partition: DataFrame, kept: DataFrame) -> DataFrame:
    """(stage, n_nodes, n_edges, n_communities, modularity) before and after the nodes not in kept(node) are removed."""
    after = edges.join(kept.select(F.col("node").alias("u")), "u", "left_semi").join(kept.select(F.col("node").alias("v")), "v", "left_semi")
    out = None
    for stage, v, e in (("before", vertices, edges), ("after", kept.select("node"), after)):
        p = partition.join(v.select("node"), "node", "left_semi")
        sizes = p.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("community").alias("n_communities"))
        row = sizes.crossJoin(e.agg(F.count(F.lit(1)).alias("n_edges"))).crossJoin(modularity(e, p)).select(F.lit(stage).alias("stage"), "n_nodes", "n_edges", "n_communities", "modularity")
        out = row if out is None else out.unionByName(row)
    return out


def sorted_communities(partition: DataFrame) -> DataFrame:
    """(community, size, members): the largest first, ties by name; members in order."""
    got = partition.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.sort_array(F.collect_list("node")), ", ").alias("members"))
    return got.orderBy(F.desc("size"), "community")
