"""Labels from ordered rules, and the classes of human isolates. Rules are data, not code."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainloom.operators.skew import skew_join
from strainloom.session import BROADCAST_ROWS, cut


@dataclass(frozen=True)
class Predicate:
    """One test of a field. op: in, not_in (null passes), contains, is_null. Values are compared in lower case."""

    field: str
    op: str
    values: tuple[str, ...] = ()

    def column(self) -> Column:
        c = F.lower(F.col(self.field))
        if self.op == "is_null":
            return c.isNull()
        if self.op == "in":
            return F.coalesce(c.isin(list(self.values)), F.lit(False))
        if self.op == "not_in":
            return ~F.coalesce(c.isin(list(self.values)), F.lit(False))
        if self.op == "contains":
            return F.coalesce(reduce(lambda a, b: a | b, [c.contains(v) for v in self.values]), F.lit(False))
        raise ValueError(f"unknown op {self.op}")


@dataclass(frozen=True)
class Rule:
    label: str
    predicates: tuple[Predicate, ...]


def matched_labels(rules: Sequence[Rule]) -> Column:
    """array<struct<priority, label>> of the rules that hold; one pass, whatever the number of rules."""
    order = {label: i for i, label in enumerate(dict.fromkeys(r.label for r in rules))}
    hits = [F.when(reduce(lambda a, b: a & b, [p.column() for p in r.predicates]), F.struct(F.lit(order[r.label]).alias("priority"), F.lit(r.label).alias("label"))) for r in rules]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def curate(rows: DataFrame, key: str, rules: Sequence[Rule], resolve: dict[str, str], eligible: Column, other: str = "others/missing") -> DataFrame:
    """(key, labels, curated): the labels of all rows of a key, in rule order, joined by a bar, and their resolution.

    Only eligible rows match rules, but a key's labels hold for all its rows. `resolve` names what a combination
    means; other combinations and keys without a label become `other`. Rows with a null key are left out.
    """
    hits = rows.where(F.col(key).isNotNull()).select(key, F.when(eligible, matched_labels(rules)).alias("m"))
    hits = hits.select(key, F.explode_outer("m").alias("m"))
    sets = hits.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_set("m")), lambda h: h["label"]), "|").alias("labels"))
    meaning = reduce(lambda acc, kv: acc.when(F.col("labels") == kv[0], kv[1]), resolve.items(), F.when(F.col("labels") == "", other))
    return sets.withColumn("curated", meaning.when(F.col("labels").contains("|"), other).otherwise(F.col("labels")))


def normal_text(value: Column, nothing: Sequence[str]) -> Column:
    """The text in lower case, null where it is one of the texts that say there is none."""
    text = F.lower(value)
    return F.when(~text.isin(list(nothing)), text)


def validate_keys(rows: DataFrame, key: str, inside: Column) -> DataFrame:
    """The rows; raises ValueError naming how many have a null key, or do not meet `inside`."""
    lost, out = rows.agg(F.count_if(F.col(key).isNull()), F.count_if(~F.coalesce(inside, F.lit(False)))).first()
    if lost:
        raise ValueError(f"{lost} rows without {key}")
    if out:
        raise ValueError(f"{out} rows from outside")
    return rows


def back_mapped(rows: DataFrame, key: str, curated: DataFrame) -> DataFrame:
    """All rows with all their columns and the labels and resolution of their key, null for a key without; a key that
    holds a large share of the rows is joined by broadcast."""
    return skew_join(rows, curated.select(key, "labels", "curated"), [key], "left")


def curated_counts(mapped: DataFrame, other: str = "others/missing") -> DataFrame:
    """(n_rows, n_labelled, n_other): all rows, those with a resolution, and those resolved to nothing."""
    return mapped.agg(F.count(F.lit(1)).alias("n_rows"), F.count("curated").alias("n_labelled"), F.count_if(F.col("curated") == other).alias("n_other"))


def parse_vector(text: Column) -> Column:
    """array<double> of a bracketed list; null and unreadable texts give an empty one."""
    parts = F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",")
    return F.coalesce(F.filter(F.transform(parts, lambda v: v.try_cast("double")), lambda v: v.isNotNull()), F.array().cast("array<double>"))


def human_class(animal_type: Column, prediction: Column, trust: Column, distances: Column, dist_cutoff: float = 38.0, trust_cutoff: float = 0.54) -> Column:
    """F, W or G: a recognised animal type as it is; without a prediction G; F when the nearest is near and trusted;
    W when the nearest is far; otherwise G."""
    kind = F.regexp_replace(F.lower(F.trim(animal_type)), "_", " ")
    nearest = F.try_element_at(distances, F.lit(1))
    return (
        F.when(kind == "food animal", "F").when(kind == "wild animal", "W").when(kind == "generalist", "G").when(prediction.isNull(), "G")
        .when((nearest <= dist_cutoff) & (trust >= trust_cutoff), "F").when(nearest > dist_cutoff, "W").otherwise("G")
    )


def keep_subset(rows: DataFrame, is_human: Column, attributed: str, subset: str) -> DataFrame:
    """All non-human rows and the human ones of the subset (all or letters of FWG)."""
    if subset != "all" and not (subset and set(subset) <= set("FWG")):
        raise ValueError(f"unknown subset {subset}")
    human = F.coalesce(is_human, F.lit(False))
    return rows if subset == "all" else rows.where(~human | F.col(attributed).isin(list(subset)))


def letters_key(value: Column, noise: Sequence[str]) -> Column:
    """The letters of a text in lower case, without the noise words and version marks ("v2")."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), rf"\b({'|'.join(noise)})\b|v[0-9]+", " "), "[^a-z]+", "")


def map_terms(rows: DataFrame, column: str, terms: DataFrame, noise: Sequence[str], most_edits: int = 2, least_part: float = 0.65) -> DataFrame:
    """(value, term) for every distinct non-null value of the column: the term of the two-part list terms(term) it is
    written for, null for none.

    Compared are the letters only, with the parts in either order: equal ones first, then those within `most_edits`
    edits, then beginnings of at least `least_part` of the letters; ties by the smaller term. The list is a small
    reference table (it goes with each row); a value's work does not depend on how many rows hold it.
    """
    parts = F.split(F.lower("term"), "[^a-z]+")
    names = terms.select("term", F.explode(F.array_distinct(F.array(F.array_join(parts, ""), F.array_join(F.reverse(parts), "")))).alias("name")).where("name <> ''")
    listed = F.broadcast(names.agg(F.collect_list(F.struct("name", "term")).alias("names")))  # one row
    keys = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().withColumn("k", letters_key(F.col("value"), noise))

    def cost(name: Column) -> Column:
        edits = F.levenshtein("k", name)
        return F.when(F.col("k") == name, 0).when(edits <= most_edits, edits).when(name.startswith(F.col("k")) & (F.length("k") >= least_part * F.length(name)), most_edits + 1)

    best = F.array_min(F.filter(F.transform("names", lambda n: F.struct(cost(n["name"]).alias("cost"), n["term"].alias("term"))), lambda n: n["cost"].isNotNull()))
    return keys.crossJoin(listed).select("value", F.when(F.col("k") != "", best["term"]).alias("term"))


def with_terms(rows: DataFrame, column: str, terms: DataFrame, noise: Sequence[str], name: str) -> DataFrame:
    """rows + name: the term of each row's value (see map_terms), null where it means none."""
    mapping = cut(map_terms(rows, column, terms, noise).withColumnsRenamed({"value": column, "term": name}))
    if mapping.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(mapping), column, "left")
    return skew_join(rows, mapping, [column], "left")


def class_in(value: Column, classes: Sequence[str]) -> Column:
    """The class a text begins or ends with ("Swine / pike hollow 10599", "Elm Ford-10739; Poultry"), null for none."""
    of = "|".join(classes)
    text = F.lower(value)
    first, last = F.regexp_extract(text, rf"^\W*({of})\b", 1), F.regexp_extract(text, rf"\b({of})\W*$", 1)
    return F.when(first != "", first).when(last != "", last)


def renamed(value: Column, names: dict[str, str]) -> Column:
    """The value by its new name; values without one stay."""
    if not names:
        return value
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[value], value)


def missing_from(needed: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """(column): the distinct non-null values of `needed` that `present` lacks."""
    return needed.select(column).where(F.col(column).isNotNull()).subtract(present.select(column))
