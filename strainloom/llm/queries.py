"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strainloom.functions.text import NO_VALUE, accession_key, outbreak_key, site_key
from strainloom.llm.canonical import map_to_reference, unmatched_values
from strainloom.llm.lookalike import canonical_texts, look_alike_classes, look_alike_pairs
from strainloom.llm.mixing import mix_sources, repetition_rates, shares_reached
from strainloom.llm.neighbours import nearest_profiles
from strainloom.llm.overlap import cross_split_pairs
from strainloom.llm.packing import pack_documents
from strainloom.llm.splits import heavy_keys, related_groups, split_by_weight
from strainloom.llm.tokens import n_tokens
from strainloom.operators.skew import skew_join
from strainloom.session import cut, read_table

META, TRAIN, TEST = "metadata_training_testing", "knn_training_cgmlst", "knn_testing_cgmlst"
TYPED_FIELDS = ["isolation_source", "host", "geo_loc_name", "curated_source_region"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_to_reference(read_table(spark, sf_dir, META), read_table(spark, sf_dir, "reference_terms"), "row_id", TYPED_FIELDS)


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmatched_values(read_table(spark, sf_dir, META), read_table(spark, sf_dir, "reference_terms"), "row_id", TYPED_FIELDS)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, group_id) of all metadata rows: tied by accession, hc5, outbreak and the sites of training profiles."""
    meta = read_table(spark, sf_dir, META).select("row_id", accession_key(F.col("biosample_acc")).alias("acc"), "hc5", outbreak_key(F.col("outbreak")).alias("code"))
    sites = read_table(spark, sf_dir, TRAIN).select(accession_key(F.col("barcode")).alias("acc"), site_key(F.col("source")).alias("site")).where("acc is not null and site is not null").distinct()
    own = F.array(
        F.struct(F.lit(1).alias("kind"), F.col("acc").alias("key")),
        F.struct(F.lit(2).alias("kind"), F.when(F.col("hc5") > 0, F.col("hc5").cast("string")).alias("key")),
        F.struct(F.lit(3).alias("kind"), F.col("code").alias("key")),
    )
    ties = meta.select("row_id", F.inline(own)).where("key is not null")
    # one row of an accession carries its sites; the accession ties the others to it
    first = meta.where("acc is not null").groupBy("acc").agg(F.min("row_id").alias("row_id"))
    at_site = first.join(sites, "acc").select("row_id", F.lit(4).alias("kind"), F.col("site").alias("key"))
    return related_groups(meta, "row_id", ties.unionByName(at_site))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = cut(_groups(spark, sf_dir))
    tied = cut(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return skew_join(grouped, tied.drop("n"), ["group_id"], heavy=heavy_keys(tied, "n", F.col("group_id"))).select("row_id", "group_id")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metadata row with its group and split."""
    grouped = cut(_groups(spark, sf_dir))
    weights = cut(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("weight")))
    heavy = heavy_keys(weights, "weight", F.col("group_id"))
    return skew_join(grouped, split_by_weight(weights, read_table(spark, sf_dir, "split_targets")), ["group_id"], heavy=heavy).select("row_id", "group_id", "split_name")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and share of each split beside its target."""
    counts = p4_splits(spark, sf_dir).groupBy("split_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))
    got = counts.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()), 6))
    return read_table(spark, sf_dir, "split_targets").join(got, "split_name", "left").select("split_name", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("share", F.lit(0.0)).alias("share"))


#: Fixed values of the problem: allele distances of near-identical profiles, neighbours of a profile.
SAME_DISTANCE, NEAR_DISTANCE, NEIGHBOURS = 0.02, 0.05, 5


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = read_table(spark, sf_dir, TRAIN), read_table(spark, sf_dir, TEST)
    near = cross_split_pairs(train, test, "profile_id", "alleles", SAME_DISTANCE).select("train_id", "eval_id")
    keys = [t.select(F.col("profile_id").alias(name), accession_key(F.col("barcode")).alias("acc")).where("acc is not null") for t, name in ((train, "train_id"), (test, "eval_id"))]
    same = skew_join(keys[0], keys[1], ["acc"]).select("train_id", "eval_id")
    meta = read_table(spark, sf_dir, META).where("hc5 > 0").select(accession_key(F.col("biosample_acc")).alias("acc"), "hc5").where("acc is not null").distinct()
    hc5 = [cut(k.join(meta, "acc").drop("acc").distinct()) for k in keys]
    cluster = skew_join(hc5[0], hc5[1], ["hc5"]).select("train_id", "eval_id")
    pairs = near.unionByName(same).unionByName(cluster).distinct()
    return pairs.select(F.least("train_id", "eval_id").alias("profile_a"), F.greatest("train_id", "eval_id").alias("profile_b"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split_name, profile_id, source) of both tables."""
    rows = [read_table(spark, sf_dir, t).select(F.lit(s).alias("split_name"), "profile_id", "source") for t, s in ((TRAIN, "training"), (TEST, "testing"))]
    return rows[0].unionByName(rows[1])


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile with the number of its overlaps with the other split."""
    pairs = cut(p5_found(spark, sf_dir))
    ends = pairs.select(F.explode(F.array("profile_a", "profile_b")).alias("profile_id")).groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    return _profiles(spark, sf_dir).join(ends, "profile_id", "left").select("split_name", "profile_id", "source", F.coalesce("n", F.lit(0)).alias("n_links"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping profiles and overlaps of each split and source."""
    return p5_links(spark, sf_dir).groupBy("split_name", "source").agg(F.count(F.lit(1)).alias("n_profiles"), F.count_if(F.col("n_links") > 0).alias("n_overlapping"), F.sum("n_links").alias("n_pairs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read_table(spark, sf_dir, TRAIN).select("profile_id", "alleles").unionByName(read_table(spark, sf_dir, TEST).select("profile_id", "alleles"))
    near = nearest_profiles(both, "profile_id", "alleles", NEIGHBOURS, NEAR_DISTANCE)
    return near.select(F.least("profile_id", "neighbour").alias("profile_a"), F.greatest("profile_id", "neighbour").alias("profile_b")).distinct()


#: Tokens of a container.
CAPACITY = 4096


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tokens, counted once. Versions of a title count as one cluster, else exact copies."""
    docs = read_table(spark, sf_dir, "documents")
    cluster = F.coalesce(F.concat(F.lit("t:"), "title_id"), F.md5("text"))
    return cut(docs.select("doc_id", "source", cluster.alias("cluster"), n_tokens(F.col("text")).alias("n_tokens")))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container."""
    return pack_documents(_sized(spark, sf_dir), "doc_id", "n_tokens", F.col("source"), F.col("cluster"), CAPACITY)


#: The slack that p7_room compares with the hard conflict.
SOURCE_SLACK = 0.02


def p7_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the share of room that stays unused and the documents that met their source, where sources
    never meet (source_slack null) and where they may for SOURCE_SLACK of the room."""
    sized, out = _sized(spark, sf_dir), None
    for slack in (None, SOURCE_SLACK):
        packed = pack_documents(sized, "doc_id", "n_tokens", F.col("source"), F.col("cluster"), CAPACITY, slack)
        boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n"), F.count_if("source_again").alias("again"))
        room = boxes.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.round(1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("unused"), F.sum("again").alias("n_source_again"))
        room = room.select(F.lit(slack).cast("double").alias("source_slack"), "*")
        out = room if out is None else out.unionByName(room)
    return out


def p8_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document in the mix."""
    return mix_sources(_sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"), "doc_id", "n_tokens")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source reached beside its target."""
    sized, targets = _sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets")
    return shares_reached(mix_sources(sized, targets, "doc_id", "n_tokens"), repetition_rates(sized, targets, "n_tokens"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has look-alikes, with its class and their number."""
    return look_alike_classes(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form."""
    return canonical_texts(read_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "canonical")


_ALL = (p1_found, p1_unmatched, p4_found, p4_splits, p4_shares, p5_found, p5_links, p5_counts, p6_found, p7_containers, p7_room, p8_mixed, p8_shares, p9_found, p9_classes, p9_canonical)
QUERIES = {q.__name__: q for q in _ALL}
_ACC = r"nullif(upper(regexp_replace(regexp_replace({}, '\.[0-9]{{1,2}}\s*$', ''), '[^A-Za-z0-9]+', '', 'g')), '')"
_NONE = ", ".join(f"'{v}'" for v in NO_VALUE)
_KEY = f"(SELECT CASE WHEN k NOT IN ({_NONE}) THEN k END FROM (SELECT {{}} AS k))"
_CODE = r"coalesce(upper(regexp_replace({}, '[^\p{{L}}\p{{N}}]+', '', 'g')), '')"
_BARE = r"regexp_replace(regexp_replace({}, '\bno\b\.?', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_GROUPS = (
    rf"""WITH RECURSIVE meta AS (SELECT row_id, {_KEY.format("coalesce(" + _ACC.format("biosample_acc") + ", '')")} AS acc, hc5, {_KEY.format(_CODE.format("outbreak"))} AS code FROM {META}),
 site AS (SELECT acc, CASE WHEN regexp_matches(b, '^\p{{L}}+[0-9]+$') THEN b END AS site FROM (SELECT acc, {_BARE.format("CASE WHEN l <> '' THEN l ELSE f END")} AS b FROM (SELECT {_KEY.format("coalesce(" + _ACC.format("barcode") + ", '')")} AS acc, regexp_extract(lower(source), '^(.*[0-9])\s*(?:;.*|\(.*\)\s*)$', 1) AS l, regexp_extract(lower(source), '^\s*\p{{L}}+\s*(?:[:/,\-]|\s{{2,}})\s*(.*[0-9].*)$', 1) AS f FROM {TRAIN}))),
 tie AS (SELECT row_id, 'a' || acc AS k FROM meta WHERE acc IS NOT NULL UNION SELECT row_id, 'h' || hc5 FROM meta WHERE hc5 > 0 UNION SELECT row_id, 'o' || code FROM meta WHERE code IS NOT NULL UNION SELECT row_id, 's' || site FROM meta JOIN site USING (acc) WHERE site IS NOT NULL),
 hub AS (SELECT k, min(row_id) AS h FROM tie GROUP BY 1 HAVING count(*) > 1), link AS (SELECT DISTINCT row_id, h FROM tie JOIN hub USING (k) WHERE row_id <> h), both_ways AS (SELECT row_id AS x, h AS y FROM link UNION SELECT h, row_id FROM link),
 reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON b.x = reach.y),
 grp AS (SELECT row_id, coalesce(least(row_id, min(y)), row_id) AS group_id FROM {META} LEFT JOIN reach ON x = row_id GROUP BY row_id)"""
)
SQL: dict[str, str] = {
    "p4_found": _GROUPS + " SELECT row_id, group_id FROM grp WHERE group_id IN (SELECT group_id FROM grp GROUP BY 1 HAVING count(*) > 1)",
    "p5_found": f"""WITH tr AS (SELECT profile_id AS t, {_ACC.format("barcode")} AS acc, alleles FROM {TRAIN}), te AS (SELECT profile_id AS e, {_ACC.format("barcode")} AS acc, alleles FROM {TEST}),
 h AS (SELECT DISTINCT {_ACC.format("biosample_acc")} AS acc, hc5 FROM {META} WHERE hc5 > 0),
 lt AS (SELECT t, generate_subscripts(alleles, 1) AS p, unnest(alleles) AS a FROM tr), le AS (SELECT e, generate_subscripts(alleles, 1) AS p, unnest(alleles) AS a FROM te),
 near AS (SELECT t, e FROM lt JOIN le ON lt.p = le.p AND lt.a > 0 AND le.a > 0 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE lt.a <> le.a) / CAST(count(*) AS DOUBLE) <= {SAME_DISTANCE}),
 pairs AS (SELECT t, e FROM near UNION SELECT t, e FROM tr JOIN te ON tr.acc = te.acc UNION SELECT t, e FROM tr JOIN h x ON x.acc = tr.acc JOIN h y ON y.hc5 = x.hc5 JOIN te ON te.acc = y.acc)
 SELECT least(t, e) AS profile_a, greatest(t, e) AS profile_b FROM pairs""",
}
_LINKS = f"SELECT split_name, profile_id, source, count(a) AS n_links FROM (SELECT 'training' AS split_name, profile_id, source FROM {TRAIN} UNION ALL SELECT 'testing', profile_id, source FROM {TEST}) LEFT JOIN (SELECT profile_a AS a FROM ({SQL['p5_found']}) UNION ALL SELECT profile_b FROM ({SQL['p5_found']})) ON a = profile_id GROUP BY 1, 2, 3"
SQL["p5_links"] = _LINKS
SQL["p5_counts"] = f"SELECT split_name, source, count(*) AS n_profiles, count(*) FILTER (WHERE n_links > 0) AS n_overlapping, CAST(sum(n_links) AS BIGINT) AS n_pairs FROM ({_LINKS}) GROUP BY 1, 2"
