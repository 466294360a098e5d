"""Queries of nearest-profile attribution, curation rules and human classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strainloom.operators import curation as U
from strainloom.operators import knn as K
from strainloom.queries.base import META
from strainloom.session import cut, read_table

TRAIN, TEST = "knn_training_cgmlst", "knn_testing_cgmlst"
CLASSES = ["aquatic", "bovine", "feed", "human", "other", "poultry", "produce", "swine", "wild"]
NEIGHBOURS = 5

RULES = [
    U.Rule("poultry", (U.Predicate("ifsac_category", "in", ("chicken", "turkey", "poultry")),)),
    U.Rule("dairy", (U.Predicate("isolation_source", "contains", ("milk", "cheese")), U.Predicate("food_origin", "not_in", ("nigeria",)))),
    U.Rule("bovine", (U.Predicate("ifsac_category", "in", ("beef", "bovine")),)),
    U.Rule("bovine", (U.Predicate("host", "in", ("bos taurus", "cattle")), U.Predicate("ifsac_category", "is_null"))),
    U.Rule("produce", (U.Predicate("isolation_source", "contains", ("sprout", "romaine", "cilantro", "papaya")),)),
    U.Rule("swine", (U.Predicate("host", "in", ("sus scrofa", "swine")),)),
]
RESOLVE = {"dairy|bovine": "dairy"}


def labelled(s, d, table):
    """id, alleles and the class of all profiles whose source names one, with or without a site; source_unmatched
    reports the others."""
    t = read_table(s, d, table)
    return t.select(F.col("profile_id").alias("id"), "alleles", U.class_in(F.col("source"), CLASSES).alias("label")).where("label is not null")


def source_unmatched(s, d):
    both = read_table(s, d, TRAIN).select("source").unionByName(read_table(s, d, TEST).select("source"))
    return both.where(U.class_in(F.col("source"), CLASSES).isNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n_profiles"))


def near(s, d, **kw):
    return K.nearest(labelled(s, d, TEST), labelled(s, d, TRAIN), NEIGHBOURS, **kw)


def searched(s, d):
    """(per label, overall, statistics' own) neighbours of one search: the k nearest of every class hold the k nearest."""
    per = cut(K.nearest(labelled(s, d, TEST), labelled(s, d, TRAIN), NEIGHBOURS, per_label=True))
    w = Window.partitionBy("query_id").orderBy("distance", "train_id")
    return per, per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEIGHBOURS)


def proba(s, d, found=None, **kw):
    return K.probabilities(near(s, d) if found is None else found, K.class_weights(labelled(s, d, TRAIN)), **kw)


def predicted(s, d, found=None):
    truth = labelled(s, d, TEST).select(F.col("id").alias("query_id"), "label")
    return K.predictions(proba(s, d, found)).join(truth, "query_id").select("query_id", "label", "prediction")


def trusted(s, d):
    """(distances to labels, overall neighbours) of one search, as far as predictions and their trust need them."""
    return K.nearest_and_labels(labelled(s, d, TEST), labelled(s, d, TRAIN), NEIGHBOURS, 3, lambda found: K.predictions(proba(s, d, found)))


def knn_trust(s, d, found=None):
    per, overall = found or trusted(s, d)
    return K.trust(per, K.predictions(proba(s, d, overall)))


def trust_statistics(s, d):
    """Distance ratios of training profiles by class: those whose id is divisible by 100, against all."""
    train = labelled(s, d, TRAIN)
    asked = train.where("id % 100 = 0")
    return K.ratio_statistics(K.nearest(asked, train, NEIGHBOURS, per_label=True), asked.select(F.col("id").alias("query_id"), "label"))


def normal_trust(s, d):
    per, overall = searched(s, d)
    return K.trust(per, K.predictions(proba(s, d, overall)), mean=True, statistics=cut(trust_statistics(s, d)))


def external(s, d):
    """All testing profiles, labelled or not, with the predicted class, whether it is theirs, and every class's probability."""
    t = read_table(s, d, TEST)
    queries = t.select(F.col("profile_id").alias("id"), "alleles", U.class_in(F.col("source"), CLASSES).alias("label"))
    p = cut(K.probabilities(K.nearest(queries, labelled(s, d, TRAIN), NEIGHBOURS), K.class_weights(labelled(s, d, TRAIN))))
    got = queries.select(F.col("id").alias("query_id"), "label").join(K.predictions(p).drop("proba"), "query_id").join(K.named_probabilities(p, CLASSES), "query_id")
    return got.withColumn("is_match", F.col("label") == F.col("prediction"))


def trust_histogram(s, d):
    found = trusted(s, d)
    return K.trust_histogram(knn_trust(s, d, found).join(predicted(s, d, found[1]).withColumn("correct", F.col("label") == F.col("prediction")), "query_id"))


#: Texts that say there is no isolation source.
NOTHING = ["not collected", "not known", "not provided"]


def in_usa(c):
    return F.coalesce(c.contains("USA") | c.contains("United States"), F.lit(False))


def to_curate(s, d):
    """Rows of the country with a key, their isolation source in lower case and null where it says nothing."""
    rows = read_table(s, d, META).where(in_usa(F.col("geo_loc_name")) & F.col("biosample_acc").isNotNull())
    return rows.withColumn("isolation_source", U.normal_text(F.col("isolation_source"), NOTHING))


def curated(s, d):
    human = F.coalesce((F.col("source_type") == "human") | (F.col("epi_type") == "clinical") | (F.col("host") == "Homo sapiens"), F.lit(False))
    return U.curate(to_curate(s, d), "biosample_acc", RULES, RESOLVE, ~human)


def curated_rows(s, d):
    """The labels on every row they hold for."""
    rows = U.validate_keys(to_curate(s, d), "biosample_acc", in_usa(F.col("geo_loc_name")))
    return U.back_mapped(rows, "biosample_acc", cut(curated(s, d)))


def human_rows(s, d):
    m = read_table(s, d, META)
    cls = U.human_class(F.col("animal_type"), F.col("prediction"), F.col("trust_rounded"), U.parse_vector(F.col("dist_int")))
    return m.select("row_id", "source", F.when(F.lower("source") == "human", cls).alias("human_class"))


def subset_counts(s, d):
    kept = U.keep_subset(human_rows(s, d), F.lower("source") == "human", "human_class", "FG")
    return kept.groupBy(F.lower("source").alias("source"), "human_class").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "source_unmatched": source_unmatched,
    "knn_topk": near,
    "knn_two_phase_topk": lambda s, d: near(s, d, pool=100),
    "knn_class_weights": lambda s, d: K.class_weights(labelled(s, d, TRAIN)),
    "knn_probabilities": proba,
    "knn_confusion": lambda s, d: K.confusion(predicted(s, d)),
    "knn_trust": knn_trust,
    "knn_trust_histogram": trust_histogram,
    "knn_trust_normal": normal_trust,
    "knn_trust_statistics": lambda s, d: trust_statistics(s, d).select("label", "n", *[F.round(c, 5).alias(c) for c in ("mean_ratio", "sd_ratio", "skewness")]),
    "knn_uniform": lambda s, d: proba(s, d, voting="uniform"),
    "knn_inverse": lambda s, d: proba(s, d, voting="inverse"),
    "knn_softmin": lambda s, d: proba(s, d, method="softmin"),
    "knn_external": external,
    "knn_cross_validation": lambda s, d: K.confusion(K.cross_validated(labelled(s, d, TRAIN), NEIGHBOURS, 10, 42)),
    "curated_labels": curated,
    "curated_rows": lambda s, d: curated_rows(s, d).select("row_id", "biosample_acc", "isolation_source", "labels", "curated"),
    "curated_counts": lambda s, d: U.curated_counts(curated_rows(s, d)),
    "human_class_fwg": human_rows,
    "attribution_subset_counts": subset_counts,
}

_OF = "|".join(CLASSES)
_CLASS = rf"coalesce(nullif(regexp_extract(lower(source), '^\W*({_OF})\b', 1), ''), nullif(regexp_extract(lower(source), '\b({_OF})\W*$', 1), ''))"
_K = f"""WITH tr AS (SELECT profile_id AS id, alleles, {_CLASS} AS label FROM {TRAIN} WHERE {_CLASS} IS NOT NULL), te AS (SELECT profile_id AS id, alleles, {_CLASS} AS label FROM {TEST} WHERE {_CLASS} IS NOT NULL),
 lt AS (SELECT id, label, generate_subscripts(alleles, 1) AS p, unnest(alleles) AS a FROM tr), le AS (SELECT id, generate_subscripts(alleles, 1) AS p, unnest(alleles) AS a FROM te),
 kn AS (SELECT e.id AS query_id, t.id AS train_id, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (WHERE e.a <> t.a) AS diff FROM le e JOIN lt t ON e.p = t.p AND e.a > 0 AND t.a > 0 GROUP BY 1, 2),
 dist AS (SELECT te.id AS query_id, tr.id AS train_id, tr.label, coalesce(diff / n, 1.0) AS raw FROM te CROSS JOIN tr LEFT JOIN kn ON kn.query_id = te.id AND kn.train_id = tr.id),
 near AS (SELECT query_id, train_id, label, round(greatest(raw, 5e-5), 9) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY raw, train_id) AS rank FROM dist QUALIFY rank <= {NEIGHBOURS}),
 cw AS (SELECT label, n, round(pow(n / (min(n) OVER () + 1.0), -1 / 2.5), 6) AS weight FROM (SELECT label, count(*) AS n FROM tr GROUP BY 1)),
 vote AS (SELECT query_id, label, sum(CASE WHEN rank = 1 THEN 1.0 ELSE (dk - distance) / (dk - d1 + 5e-5) END) AS w FROM (SELECT *, min(distance) OVER (PARTITION BY query_id) AS d1, max(distance) OVER (PARTITION BY query_id) AS dk FROM near) GROUP BY 1, 2),
 z AS (SELECT te.id AS query_id, cw.label, cw.weight * coalesce(w, 0) AS z FROM te CROSS JOIN cw LEFT JOIN vote ON vote.query_id = te.id AND vote.label = cw.label),
 proba AS (SELECT query_id, label, round(exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY query_id), 6) AS proba FROM (SELECT *, max(z) OVER (PARTITION BY query_id) AS mz FROM z)),
 pred AS (SELECT query_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY proba DESC, label) AS r FROM proba) WHERE r = 1)"""
_HUMAN = f"""SELECT row_id, source, CASE WHEN lower(source) = 'human' THEN CASE replace(lower(trim(animal_type)), '_', ' ') WHEN 'food animal' THEN 'F' WHEN 'wild animal' THEN 'W' WHEN 'generalist' THEN 'G' ELSE
 CASE WHEN prediction IS NULL THEN 'G' WHEN d <= 38 AND trust_rounded >= 0.54 THEN 'F' WHEN d > 38 THEN 'W' ELSE 'G' END END END AS human_class FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(dist_int, '[\\[\\]\\s]', '', 'g'), ','), lambda v: TRY_CAST(v AS DOUBLE)), lambda v: v IS NOT NULL)[1] AS d FROM {META})"""

_CURATED = f"""WITH u AS (SELECT * REPLACE (CASE WHEN lower(isolation_source) NOT IN ('not collected', 'not known', 'not provided') THEN lower(isolation_source) END AS isolation_source) FROM {META} WHERE biosample_acc IS NOT NULL AND (contains(geo_loc_name, 'USA') OR contains(geo_loc_name, 'United States'))),
 e AS (SELECT * FROM u WHERE NOT coalesce(source_type = 'human' OR epi_type = 'clinical' OR host = 'Homo sapiens', FALSE)),
 h AS (SELECT biosample_acc, 0 AS p, 'poultry' AS l FROM e WHERE lower(ifsac_category) IN ('chicken', 'turkey', 'poultry')
  UNION SELECT biosample_acc, 1, 'dairy' FROM e WHERE (contains(lower(isolation_source), 'milk') OR contains(lower(isolation_source), 'cheese')) AND coalesce(lower(food_origin) <> 'nigeria', TRUE)
  UNION SELECT biosample_acc, 2, 'bovine' FROM e WHERE lower(ifsac_category) IN ('beef', 'bovine') OR (ifsac_category IS NULL AND lower(host) IN ('bos taurus', 'cattle'))
  UNION SELECT biosample_acc, 3, 'produce' FROM e WHERE regexp_matches(lower(isolation_source), 'sprout|romaine|cilantro|papaya')
  UNION SELECT biosample_acc, 4, 'swine' FROM e WHERE lower(host) IN ('sus scrofa', 'swine')),
 g AS (SELECT biosample_acc, coalesce(string_agg(l, '|' ORDER BY p), '') AS labels FROM (SELECT DISTINCT biosample_acc FROM u) LEFT JOIN h USING (biosample_acc) GROUP BY 1),
 l AS (SELECT biosample_acc, labels, CASE WHEN labels = '' THEN 'others/missing' WHEN labels = 'dairy|bovine' THEN 'dairy' WHEN contains(labels, '|') THEN 'others/missing' ELSE labels END AS curated FROM g)"""

SQL = {
    "source_unmatched": f"SELECT source, count(*) AS n_profiles FROM (SELECT source FROM {TRAIN} UNION ALL SELECT source FROM {TEST}) WHERE {_CLASS} IS NULL GROUP BY 1",
    "knn_topk": _K + " SELECT * FROM near",
    "knn_class_weights": _K + " SELECT * FROM cw",
    "knn_probabilities": _K + " SELECT * FROM proba",
    "knn_uniform": _K + ", uv AS (SELECT query_id, label, CAST(count(*) AS DOUBLE) AS w FROM near GROUP BY 1, 2), uz AS (SELECT te.id AS query_id, cw.label, cw.weight * coalesce(w, 0) AS z FROM te CROSS JOIN cw LEFT JOIN uv ON uv.query_id = te.id AND uv.label = cw.label) SELECT query_id, label, round(exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY query_id), 6) AS proba FROM (SELECT *, max(z) OVER (PARTITION BY query_id) AS mz FROM uz)",
    "knn_inverse": _K + ", uv AS (SELECT query_id, label, sum(2 / distance) AS w FROM near GROUP BY 1, 2), uz AS (SELECT te.id AS query_id, cw.label, cw.weight * coalesce(w, 0) AS z FROM te CROSS JOIN cw LEFT JOIN uv ON uv.query_id = te.id AND uv.label = cw.label) SELECT query_id, label, round(exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY query_id), 6) AS proba FROM (SELECT *, max(z) OVER (PARTITION BY query_id) AS mz FROM uz)",
    "knn_softmin": _K + f", sv AS (SELECT query_id, label, sum(-1 / greatest(CASE WHEN rank = 1 THEN 1.0 ELSE (dk - distance) / (dk - d1 + 5e-5) END, 5e-5) / kk) AS w FROM (SELECT *, min(distance) OVER (PARTITION BY query_id) AS d1, max(distance) OVER (PARTITION BY query_id) AS dk, count(*) OVER (PARTITION BY query_id) AS kk FROM near) GROUP BY 1, 2), uz AS (SELECT te.id AS query_id, cw.label, coalesce(w, 0) / cw.weight AS z FROM te CROSS JOIN cw LEFT JOIN sv ON sv.query_id = te.id AND sv.label = cw.label) SELECT query_id, label, round(exp(z - mz) / sum(exp(z - mz)) OVER (PARTITION BY query_id), 6) AS proba FROM (SELECT *, max(z) OVER (PARTITION BY query_id) AS mz FROM uz)",
    "knn_external": _K.replace(f"AS label FROM {TEST} WHERE {_CLASS} IS NOT NULL", f"AS label FROM {TEST}") + " SELECT te.id AS query_id, te.label, prediction, te.label = prediction AS is_match, " + ", ".join(f"max(CASE WHEN proba.label = '{c}' THEN proba END) AS p_{c}" for c in CLASSES) + " FROM te JOIN pred ON pred.query_id = te.id JOIN proba ON proba.query_id = te.id GROUP BY 1, 2, 3, 4",
    "knn_confusion": _K + ", c AS (SELECT te.label, prediction, count(*) AS n FROM pred JOIN te ON te.id = query_id GROUP BY 1, 2) SELECT label, prediction, n, CASE WHEN label = prediction THEN round(n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE), 6) END AS recall FROM c",
    "knn_trust": _K + ", pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY raw, train_id) AS r FROM dist), md AS (SELECT query_id, label, median(round(greatest(raw, 5e-5), 9)) AS d FROM pl WHERE r <= 3 GROUP BY 1, 2) SELECT query_id, round(1 / (1 + exp(-2.0 * (min(CASE WHEN label <> prediction THEN d END) / (min(CASE WHEN label = prediction THEN d END) + 1e-7) - 1))), 6) AS trust FROM md JOIN pred USING (query_id) GROUP BY 1",
    "knn_two_phase_topk": _K
    + f""", g(p) AS (SELECT * FROM range(1, 241)), ct AS (SELECT tr.id, p, greatest(coalesce(alleles[p], 0), 0) AS a FROM tr, g), ce AS (SELECT te.id, p, greatest(coalesce(alleles[p], 0), 0) AS a FROM te, g),
 pd AS (SELECT ce.id AS query_id, ct.id AS train_id, count(*) FILTER (WHERE ce.a <> ct.a) AS plain FROM ce JOIN ct USING (p) GROUP BY 1, 2),
 pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY plain, train_id) AS o FROM pd QUALIFY o <= 100)
 SELECT query_id, train_id, label, round(greatest(raw, 5e-5), 9) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY raw, train_id) AS rank FROM pool JOIN dist USING (query_id, train_id) QUALIFY rank <= {NEIGHBOURS}""",
    "curated_labels": _CURATED + " SELECT * FROM l",
    "curated_rows": _CURATED + " SELECT row_id, biosample_acc, isolation_source, labels, curated FROM u LEFT JOIN l USING (biosample_acc)",
    "curated_counts": _CURATED + " SELECT count(*) AS n_rows, count(curated) AS n_labelled, count(*) FILTER (WHERE curated = 'others/missing') AS n_other FROM u LEFT JOIN l USING (biosample_acc)",
    "human_class_fwg": _HUMAN,
    "attribution_subset_counts": f"SELECT lower(source) AS source, human_class, count(*) AS n FROM ({_HUMAN}) WHERE NOT coalesce(lower(source) = 'human', FALSE) OR human_class IN ('F', 'G') GROUP BY 1, 2",
}
_TRUST = SQL["knn_trust"].rpartition(" SELECT query_id, round(1")
SQL["knn_trust_histogram"] = (
    f"{_TRUST[0]}, ts AS ({(_TRUST[1] + _TRUST[2]).strip()}), sc AS (SELECT trust, te.label = prediction AS correct, min(trust) OVER () AS lo, max(trust) OVER () AS hi FROM ts JOIN pred USING (query_id) JOIN te ON te.id = query_id)"
    " SELECT CAST(CASE WHEN hi > lo THEN least(14, floor((trust - lo) / (hi - lo) * 15)) ELSE 0 END AS INT) AS bin, count(*) AS n, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM sc GROUP BY 1"
)
