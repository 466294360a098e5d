"""Free-typed values mapped to a reference list.

Each distinct token is repaired by an edit-distance join with the vocabulary of the reference list (deletion
neighbourhoods make it an equi-join), then the repaired tokens are combined with soft TF-IDF to rank complete
entries. Everything works on distinct values and distinct tokens; the rows are joined once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainloom.operators.skew import skew_join
from strainloom.session import BROADCAST_ROWS, cut, require_columns

#: An entry is accepted when this share of its token weight is explained; less will do when several tokens do it.
MIN_COVERAGE, MIN_COVERAGE_SEVERAL = 0.72, 0.58
#: Tokens in more than this share of a field's names say nothing beside others (USA in "USA: Ohio").
COMMON_TOKEN = 0.25
#: A shortened joined name ("layerhengulfco") needs this share of its letters.
MIN_JOINED = 0.68


def tokens_of(value: Column) -> Column:
    """Lower-case letter-and-digit runs, without pure numbers; dotted initials ("U.S.A.") count as one token."""
    text = F.regexp_replace(F.lower(value), r"(?<=(?:^|[^\p{L}\p{N}])\p{L})\.(?=\p{L}(?:[^\p{L}\p{N}]|$))", "")
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))


def _deletes(t: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))


def _variants(t: Column) -> Column:
    """Hashes of the token with up to two letters deleted (one below five letters, none below three)."""
    one = F.when(F.length(t) >= 3, _deletes(t)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(t) >= 5, F.flatten(F.transform(_deletes(t), _deletes))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.array(t), one, two), lambda v: F.xxhash64(v)))


def _above(named: DataFrame) -> DataFrame:
    """(field_name, ref_id, above): the entries an entry refines, those with a name whose tokens are a proper part of the
    tokens of one of its names ("USA" of "USA: Ohio"). A name looks for others by its rarest token only, so a token of
    very many names makes no pairs among them."""
    single = named.select("field_name", "name_id", "ref_id", "tokens", F.explode("tokens").alias("token"))
    df = single.groupBy("field_name", "token").agg(F.count(F.lit(1)).alias("df"))
    rarest = single.join(df, ["field_name", "token"]).groupBy("field_name", "name_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.first("ref_id").alias("general"), F.first("tokens").alias("part"))
    found = single.join(rarest.drop("name_id"), ["field_name", "token"]).where((F.col("general") != F.col("ref_id")) & (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
    return found.groupBy("field_name", "ref_id").agg(F.collect_set("general").alias("above"))


def _names(reference: DataFrame) -> DataFrame:
    """(field_name, name_id, ref_id, token, idf, whole, weight, above): the tokens of every term and other name; a name of several
    tokens also stands as one joined token. Codes ("USA:AL", a token of one or two letters) stand joined only."""
    named = reference.select("field_name", "ref_id", F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("alt_names", F.array().cast("array<string>"))))).alias("name"))
    named = named.where(F.col("name").isNotNull()).withColumn("tokens", F.array_distinct(tokens_of(F.col("name")))).where(F.size("tokens") > 0)
    named = named.withColumn("name_id", F.xxhash64("field_name", "ref_id", "name"))
    total = named.groupBy("field_name").agg(F.count(F.lit(1)).alias("n_names"))
    single = named.select("field_name", "name_id", "ref_id", "tokens", F.explode("tokens").alias("token"))
    df = single.groupBy("field_name", "token").agg(F.count(F.lit(1)).alias("df"))
    single = single.join(df, ["field_name", "token"]).join(total, "field_name")
    single = single.withColumn("idf", F.log(1 + F.col("n_names") / F.col("df"))).withColumn("common", (F.col("df") > COMMON_TOKEN * F.col("n_names")) & (F.col("n_names") >= 8))
    code = F.exists("tokens", lambda t: F.length(t) <= 2) & (F.size("tokens") > 1)
    apart = single.where(~code & (~F.col("common") | (F.size("tokens") == 1))).select("field_name", "name_id", "ref_id", "token", "idf")
    joined = (
        single.where(F.size("tokens") > 1)
        .groupBy("field_name", "name_id", "ref_id", "tokens")
        .agg(F.sum(F.when(F.col("common"), 0.0).otherwise(F.col("idf"))).alias("idf"))
        .select("field_name", (F.col("name_id") + F.lit(1).cast("long")).alias("name_id"), "ref_id", F.array_join("tokens", "").alias("token"), "idf", code.alias("whole"))
    )
    both = apart.withColumn("whole", F.lit(False)).unionByName(joined)
    weights = both.groupBy("field_name", "name_id").agg(F.sum("idf").alias("weight"))
    return both.join(weights, ["field_name", "name_id"]).join(_above(named), ["field_name", "ref_id"], "left").withColumn("above", F.coalesce("above", F.array().cast("array<long>")))


def _vocabulary(names: DataFrame) -> DataFrame:
    """(field_name, spelling, token, share): every name token and its beginnings; share is the part that is there.
    A code has no beginnings."""
    tokens = names.groupBy("field_name", "token").agg(F.min("whole").alias("whole"))
    spelt = tokens.select("field_name", "token", F.explode(F.sequence(F.when(F.col("whole"), F.length("token")).otherwise(F.lit(1)), F.length("token"))).alias("n"))
    return spelt.select("field_name", "token", F.substring(F.col("token"), F.lit(1), F.col("n")).alias("spelling"), (F.col("n") / F.length("token")).alias("share"))


def _forms(token: Column) -> Column:
    """The readings of a token, each with its cost: as it is; without a plural s; m read as rn; digits read for letters."""
    forms = [(token, 0.0), (F.when((F.length(token) >= 4) & token.endswith("s"), F.substring(token, F.lit(1), F.length(token) - 1)), 0.0), (F.replace(token, F.lit("rn"), F.lit("m")), 1.0)]
    for look in ("ois", "ols"):
        read = F.translate(token, "015", look)
        forms += [(read, 0.5), (F.when((F.length(token) >= 4) & token.endswith("s"), F.substring(read, F.lit(1), F.length(token) - 1)), 0.5)]
    made = F.array(*[F.struct(f.alias("form"), F.lit(c).alias("cost")) for f, c in forms])
    return F.filter(made, lambda x: x["form"].isNotNull() & ((x["form"] != token) | (x["cost"] == 0)))


def _swaps(t: Column) -> Column:
    """The token with each pair of neighbours swapped."""
    return F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.lit(1)), F.substring(t, i, F.lit(1)), F.substring(t, i + 2, F.length(t))))


def _edits(form: Column, spelling: Column, plain: Column) -> Column:
    """Edit distance in which a swap of neighbours is one edit, exact up to 2; plain is the one without swaps."""
    swapped = _swaps(form)
    after = F.array_min(F.transform(swapped, lambda s: F.levenshtein(s, spelling)))
    twice = F.when(F.arrays_overlap(swapped, _swaps(spelling)), 2)
    long = (F.length(form) > 1) & (F.length(spelling) > 1)
    return F.when((plain >= 2) & long, F.least(plain, 1 + after, twice)).otherwise(plain)


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field_name, token, word, sim, share, n) for the distinct (field_name, token) rows: reference words within two
    edits (one below five letters; a swap of neighbours counts as one), whole and shortened (share below 1)."""
    longest = vocabulary.agg(F.max(F.length("spelling"))).first()[0] or 0
    forms = tokens.select("field_name", "token", F.inline(_forms(F.col("token")))).where(F.length("form") <= longest + 2)  # a longer form is more than two edits away
    left = forms.select("field_name", "token", "form", "cost", F.explode(_variants(F.col("form"))).alias("v"))
    right = vocabulary.select("field_name", F.col("token").alias("word"), "spelling", "share", F.explode(_variants(F.col("spelling"))).alias("v"))
    pairs = left.join(right, ["field_name", "v"]).groupBy("field_name", "token", "form", "word", "spelling", "share").agg(F.min("cost").alias("cost"))
    longer = F.greatest(F.length("form"), F.length("spelling"))
    pairs = pairs.withColumn("plain", F.levenshtein("form", "spelling", 4)).where("plain >= 0")
    pairs = pairs.withColumn("edits", _edits(F.col("form"), F.col("spelling"), F.col("plain")))
    allowed = F.when(longer >= 5, 2).when(longer >= 3, 1).otherwise(0)
    kept = pairs.where(F.col("edits") <= allowed)
    kept = kept.where((F.col("share") == 1) | (F.col("edits") == 0) | ((F.length("spelling") >= 4) & (F.col("edits") <= F.when(F.length("spelling") >= 6, 2).otherwise(1))))
    sim = F.greatest(F.lit(0.0), 1 - (F.col("edits") + F.col("cost")) / longer)
    best = kept.withColumn("sim", sim).groupBy("field_name", "token", "word", (F.col("share") == 1).alias("whole")).agg(F.max_by(F.struct("sim", "share", F.length("spelling").alias("n")), F.struct(F.col("sim") * (0.4 + 0.6 * F.col("share")), "share")).alias("m"))
    return best.select("field_name", "token", "word", "m.sim", "m.share", "m.n")


def rank_entries(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(field_name, norm, ref_id) for the distinct (field_name, norm, tokens) rows that mean an entry.

    Soft TF-IDF: a name's score is the idf-weighted similarity of its tokens to the value's; names explained to
    MIN_COVERAGE (by several tokens: MIN_COVERAGE_SEVERAL) or more compete; an entry
    gives way to one that refines it, then the most specific (largest explained weight) wins, then the best explained,
    then the smallest ref_id.
    """
    names = cut(_names(reference))
    spread = values.select("field_name", "norm", F.posexplode("tokens").alias("pos", "token"), (F.size("tokens") - 1).alias("last")).select("field_name", "norm", "token", (F.col("pos") == F.col("last")).alias("at_end"), F.lit(False).alias("pair"))
    pairs = values.where(F.size("tokens") > 1).select("field_name", "norm", F.explode(F.zip_with(F.slice("tokens", 1, F.size("tokens") - 1), F.slice("tokens", 2, F.size("tokens") - 1), lambda a, b: F.concat(a, b))).alias("token"), F.lit(False).alias("at_end"), F.lit(True).alias("pair"))
    matches = repair_tokens(spread.select("field_name", "token").distinct(), _vocabulary(names))
    exact = names.select("field_name", F.col("token").alias("word")).distinct()
    alone = spread.join(matches, ["field_name", "token"]).where((F.col("share") == 1) | (F.col("n") >= 3) | F.col("at_end"))
    beside = pairs.join(exact, (pairs.field_name == exact.field_name) & (pairs.token == exact.word)).select(pairs.field_name, "norm", "word", F.lit(1.0).alias("sim"), F.lit(1.0).alias("share"))
    found = alone.select("field_name", "norm", "word", "sim", "share").unionByName(beside)
    best = found.groupBy("field_name", "norm", "word").agg(F.max(F.col("sim") * (0.4 + 0.6 * F.col("share"))).alias("sim"), F.max("share").alias("share"))
    scored = best.join(names.withColumnRenamed("token", "word"), ["field_name", "word"])
    scored = scored.groupBy("field_name", "norm", "name_id", "ref_id", "weight").agg(F.sum(F.col("idf") * F.col("sim")).alias("score"), F.min("share").alias("least"), F.count(F.lit(1)).alias("n"), F.first("above").alias("above"))
    cover = F.col("score") / F.col("weight")
    several = F.col("n") > 1
    kept = scored.where((cover >= F.when(several, MIN_COVERAGE_SEVERAL).otherwise(MIN_COVERAGE)) & (several | (F.col("least") >= MIN_JOINED)))
    # an entry gives way to those that refine it; a value has at most as many candidates as the list has names
    ranked = kept.select("field_name", "norm", F.struct(F.round("score", 9).alias("s"), F.round(cover, 9).alias("c"), (-F.col("ref_id")).alias("r")).alias("b"), "above")
    all_of = ranked.groupBy("field_name", "norm").agg(F.collect_list("b").alias("bs"), F.array_distinct(F.flatten(F.collect_list("above"))).alias("general"))
    best = F.array_max(F.filter("bs", lambda x: ~F.array_contains("general", -x["r"])))
    return all_of.select("field_name", "norm", (-best["r"]).alias("ref_id"))


def long_values(rows: DataFrame, reference: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field_name, value, tokens, norm) of the values that are not null and not exactly a term of their field."""
    require_columns(rows, [id_col, *fields], "canonical values")
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])
    long = rows.select(F.col(id_col), F.explode(cells).alias("c")).select(id_col, "c.field_name", "c.value").where(F.col("value").isNotNull())
    terms = reference.select("field_name", F.col("term").alias("value")).distinct()
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        terms = F.broadcast(terms)
    long = long.join(terms, ["field_name", "value"], "left_anti")
    return long.withColumn("tokens", tokens_of(F.col("value"))).withColumn("norm", F.array_join("tokens", " "))


def map_to_reference(rows: DataFrame, reference: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field_name, ref_id): for each cell of `fields` that is not null and not exactly a term, the entry it
    means, or -1 for none.

    Empty values, values without letters and texts that say "missing" share no token with the list and give -1.
    Repeated rows all stay, an empty table gives no rows, an empty reference list -1 throughout; other columns of
    `rows` are ignored. A value held by a third of all rows meets the mapping through a broadcast join.
    """
    long = long_values(rows, reference, id_col, fields)
    values = cut(long.groupBy("field_name", "norm").agg(F.first("tokens").alias("tokens")).where("norm <> ''"))
    mapped = cut(rank_entries(values, reference))
    joined = skew_join(long.select(id_col, "field_name", "norm"), mapped, ["field_name", "norm"], "left")
    return joined.select(id_col, "field_name", F.coalesce("ref_id", F.lit(-1).cast("long")).alias("ref_id"))


def unmatched_values(rows: DataFrame, reference: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(field_name, value, n_rows): the values that mean no entry, with their counts."""
    long = long_values(rows, reference, id_col, fields)
    counts = cut(long.groupBy("field_name", "value", "norm").agg(F.count(F.lit(1)).alias("n_rows")))
    values = counts.where("norm <> ''").groupBy("field_name", "norm").agg(F.split(F.col("norm"), " ").alias("tokens"))
    return counts.join(rank_entries(values, reference), ["field_name", "norm"], "left_anti").select("field_name", "value", "n_rows")
