"""Text that looks the same but differs in its characters, brought to one form.

The vocabulary (tokens in one script, composed, without ligatures, width or invisible variants) is kept in tries; every
other token traverses them with a weighted edit automaton in which look-alikes, ligatures and ignorable characters cost
nothing and other edits something, and takes the best of the spellings it ends on within its budget; tokens that end
nowhere are normalised by table. Tries are built for buckets of tokens that share a beginning and a length, so no task
holds the vocabulary.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strainloom.operators.skew import skew_join
from strainloom.session import cut

# Letters of Cyrillic and Greek that look like Latin ones, in natural order.
CYRILLIC = "АВЕІЈКМНОРСТХЅаеіјорсухѕ"
CYRILLIC_LOOKS = "ABEIJKMHOPCTXSaeijopcyxs"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο"
GREEK_LOOKS = "ABEZHIKMNOPTYXvo"
# Ligatures and the letters they look like.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
# Code points of blanks that look like a space, and of characters that show nothing.
BLANKS = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
IGNORED = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF]

_LOOKS = dict(zip(CYRILLIC + GREEK, CYRILLIC_LOOKS + GREEK_LOOKS))
_WIDE = {chr(0xFF00 + o - 0x20): chr(o) for o in range(0x21, 0x7F) if chr(o).isalnum()}
_TABLE = {ord(k): v for k, v in (_LOOKS | _WIDE | LIGATURES).items()} | {o: " " for o in BLANKS}
_DROP = {o: None for o in IGNORED}


_BLANK = re.compile("[" + "".join(map(chr, BLANKS)) + "]")


def _ranges(chars: list[int]) -> str:
    """Code points as the inside of a character class."""
    chars = sorted(chars)
    starts = [c for i, c in enumerate(chars) if not i or chars[i - 1] != c - 1]
    ends = [c for i, c in enumerate(chars) if i + 1 == len(chars) or chars[i + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


_MARKS = [c for c in range(0x300, 0x11000) if unicodedata.category(chr(c))[0] == "M"]
#: A token: letters, digits, marks and ignorable characters in a row.
TOKEN = re.compile(rf"[\w{_ranges(_MARKS)}{_ranges(IGNORED)}]+")
_PLAIN_SIGNS = frozenset(_WIDE) | frozenset(LIGATURES) | frozenset(map(chr, IGNORED)) | frozenset(map(chr, _MARKS))


def _script(c: str) -> int:
    """1 Cyrillic, 2 Greek, 0 any other."""
    o = ord(c)
    return 1 if 0x400 <= o < 0x530 else 2 if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else 0


@functools.lru_cache(200_000)
def _kind(token: str) -> tuple[bool, bool]:
    """(in the vocabulary, its own canonical spelling): a vocabulary token has one script and no variant signs; it is
    settled if it is not Cyrillic or Greek, or has a letter that only its script has."""
    if token.isascii():
        return True, True
    if not _PLAIN_SIGNS.isdisjoint(token):
        return False, False
    scripts = {_script(c) for c in token if c.isalpha()}
    if len(scripts) != 1:
        return not scripts, not scripts
    return True, scripts == {0} or any(_script(c) and unicodedata.normalize("NFD", c)[0] not in _LOOKS for c in token)


# base letters of composed ones, so that a bucket does not depend on how accents are written
_COMPOSED = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]) if unicodedata.normalize("NFD", c)[0] != c]
_FROM = "".join(_COMPOSED) + "".join(_LOOKS) + "".join(_WIDE)
_TO = "".join(_LOOKS.get(b, b) for b in (unicodedata.normalize("NFD", c)[0] for c in _COMPOSED)) + "".join(_LOOKS.values()) + "".join(_WIDE.values())


def by_table(text: str) -> str:
    """The text with look-alikes, widths and blanks replaced, ignorable characters dropped and accents composed."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.translate(_DROP)).translate(_TABLE))


def _bucket(token: Column, buckets: int) -> Column:
    """A bucket that all spellings of a look share: of the first three base letters and their number."""
    for ligature, letters in LIGATURES.items():
        token = F.replace(token, F.lit(ligature), F.lit(letters))
    bare = F.regexp_replace(F.translate(token, _FROM, _TO), rf"[\p{{M}}{''.join(map(chr, IGNORED))}]+", "")
    return F.pmod(F.xxhash64(F.substring(bare, 1, 3), F.length(bare)), F.lit(buckets)).alias("bucket")


#: Cost of a character that is replaced by one that looks different, missing or too many.
EDIT = 1.0


class Trie:
    """Spellings by their decomposed characters. A node is a dict of arcs: character to node; words end in a node."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.words: dict[int, list[tuple[int, int, str]]] = {}

    def add(self, word: str, count: int) -> None:
        node = 0
        for c in unicodedata.normalize("NFD", word):
            following = self.arcs[node].get(c)
            if following is None:
                following = self.arcs[node][c] = len(self.arcs)
                self.arcs.append({})
            node = following
        script = 0 if any("LATIN" in unicodedata.name(c, "") for c in word) or word.isascii() else 1 if any(c in _CYRILLIC_SET for c in word) else 2
        self.words.setdefault(node, []).append((script, -count, word))

    def _alike(self, states: dict[int, float], look: str) -> dict[int, float]:
        """States after one character that looks like `look`, at no cost."""
        out: dict[int, float] = {}
        for node, cost in states.items():
            for c in _FAMILY.get(look, look):
                to = self.arcs[node].get(c)
                if to is not None and cost < out.get(to, float("inf")):
                    out[to] = cost
        return out

    def _closed(self, states: dict[int, float], budget: float) -> dict[int, float]:
        """States with those reached by characters that the token lacks."""
        todo = list(states.items())
        while todo:
            node, cost = todo.pop()
            for to in self.arcs[node].values():
                if cost + EDIT <= budget and cost + EDIT < states.get(to, float("inf")):
                    states[to] = cost + EDIT
                    todo.append((to, cost + EDIT))
        return states

    def walk(self, token: str, budget: float = 0.0) -> list[tuple[float, int, int, str]]:
        """(cost, script, -count, spelling) of the spellings within the budget. The automaton holds every node it may be
        in with its cost: a look-alike takes each arc of its look and a ligature one for each of its letters for free,
        an ignorable character or an unseen mark stays; any other edit costs EDIT."""
        states = self._closed({0: 0.0}, budget)
        for c in unicodedata.normalize("NFD", token):
            if ord(c) in _DROP:
                continue
            following = states
            for look in _TABLE.get(ord(c), c):
                following = self._alike(following, look)
            for node, cost in states.items() if budget else ():
                for to in (node, *self.arcs[node].values()):  # too many, or another one
                    if cost + EDIT <= budget and cost + EDIT < following.get(to, float("inf")):
                        following[to] = cost + EDIT
            states = self._closed(following, budget)
            if not states:
                return []
        return [(cost, *w) for node, cost in states.items() for w in self.words.get(node, ())]


#: Tokens a bucket should hold.
BUCKET = 20_000
_CYRILLIC_SET = set(map(chr, range(0x400, 0x530)))
#: All characters of a look.
_FAMILY = {look: look + "".join(c for c, v in (_LOOKS | _WIDE).items() if v == look) for look in {*_LOOKS.values(), *_WIDE.values()}}


def canonical_spellings(vocabulary: DataFrame, tokens: DataFrame, budget: float = 0.0) -> DataFrame:
    """(token, canonical) for distinct `tokens`; vocabulary is (token, n) with one-script spellings and counts.

    Of the spellings a token reaches within `budget` the cheapest wins, then the Latin one, then Cyrillic, then Greek, then the more
    frequent, then the smaller. A token that reaches none is normalised by table. With the budget 0 only characters that
    make no visible difference are free; a larger one repairs misread letters too (bucketed by the first three base
    letters and the length, so not there).
    """

    def spell(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for word, n in zip(words["token"], words["n_docs"]) if len(asked) else ():
            trie.add(word, n)
        found = [min(w)[3] if (w := trie.walk(t, budget)) else by_table(t) for t in asked["token"]]
        return pd.DataFrame({"token": asked["token"], "canonical": found}, dtype=object)

    buckets = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(vocabulary.count() + tokens.count()) // BUCKET))
    words = vocabulary.select("token", "n_docs", _bucket(F.col("token"), buckets))
    asked = tokens.select("token", _bucket(F.col("token"), buckets))
    return asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInPandas(lambda a, w: spell(w, a), "token string, canonical string")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vocabulary tokens with their documents (id null, counted by task) and the tokens each document asks about."""
    schema, seen = None, Counter()
    for batch in batches:
        ids, tokens = [], []
        for key, text in zip(batch.column(0), batch.column(1)):
            words = set(TOKEN.findall(text.as_py()))
            kinds = [(w, *_kind(w)) for w in words]
            seen.update([w for w, known, _ in kinds if known])
            for w, _, settled in kinds:
                if not settled:
                    ids.append(key)
                    tokens.append(w)
        schema = batch.schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in ids], schema), pa.array(tokens, pa.string()), pa.nulls(len(ids), pa.int64())], ["id", "token", "n"])
    if schema is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), schema), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["id", "token", "n"])


@F.pandas_udf(StringType())
def _render(texts: pd.Series, tokens: pd.Series, spellings: pd.Series) -> pd.Series:
    def one(text, names, forms):
        text = _BLANK.sub(" ", text)
        if names is None:
            return text
        known = dict(zip(names, forms))
        return TOKEN.sub(lambda m: known.get(m.group(), m.group()), text)

    return pd.Series([one(t, n, f) for t, n, f in zip(texts, tokens, spellings)], dtype=object)


def canonical_texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, canonical): every document with a text and that text in its one form.

    Ids are unique. Null texts give no row, an empty text stays empty. Case, accents, punctuation, the number of
    blanks and lines stay as they are. Very long texts are taken whole; other columns are ignored.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    kind = docs.schema["id"].dataType.simpleString()
    scanned = cut(docs.mapInArrow(_scan, f"id {kind}, token string, n long"))
    vocabulary = cut(scanned.where("id is null").groupBy("token").agg(F.sum("n").alias("n_docs")))
    asked = scanned.where("id is not null").select("id", "token")
    spelt = canonical_spellings(vocabulary, cut(asked.select("token").distinct())).where(F.col("token") != F.col("canonical"))
    maps = skew_join(asked, cut(spelt), ["token"]).groupBy("id").agg(F.collect_list("token").alias("names"), F.collect_list("canonical").alias("forms"))
    plain = F.octet_length("text") == F.length("text")  # ASCII only
    rendered = docs.where(~plain).join(maps, "id", "left").select("id", "text", _render("text", "names", "forms").alias("canonical"))
    return docs.where(plain).select("id", "text", F.col("text").alias("canonical")).unionByName(rendered).withColumnRenamed("id", id_col)


def _looks(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, look, own) of the documents whose look has more than one text, and (look, own, n) of those texts."""
    canon = canonical_texts(documents, id_col, text_col)
    prints = cut(canon.select(F.col(id_col).alias("id"), F.md5("canonical").alias("look"), F.md5("text").alias("own")))
    texts = cut(prints.groupBy("look", "own").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))
    several = texts.groupBy("look").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("size"), F.min("least").alias("class_id")).where("k > 1")
    classes = cut(texts.join(several, "look").select("look", "own", "n", "size", "class_id"))
    return skew_join(prints, classes.select("own", "look"), ["own", "look"]).select("id", "own"), classes


def look_alike_pairs(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_a, doc_b): pairs of documents, smaller id first, whose texts look the same but are not the same characters.

    Only differing texts make a pair, so a group of exact copies gives none among themselves: the texts of a look are
    paired first, then each pair's documents.
    """
    docs, classes = _looks(documents, id_col, text_col)
    docs = cut(docs)
    texts = classes.select("look", F.col("own").alias("own_a")).join(classes.select("look", F.col("own").alias("own_b")), "look").where("own_a < own_b").select("own_a", "own_b")
    first = skew_join(docs.withColumnsRenamed({"id": "a", "own": "own_a"}), texts, ["own_a"]).select("a", "own_b")
    both = skew_join(first, docs.withColumnsRenamed({"id": "b", "own": "own_b"}), ["own_b"])
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def look_alike_classes(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_links): one row for each document whose text has a look-alike that is not the same characters;
    class_id is the smallest id of that look, n_links the number of such look-alikes."""
    docs, classes = _looks(documents, id_col, text_col)
    links = classes.select("own", "class_id", (F.col("size") - F.col("n")).alias("n_links"))
    return skew_join(docs, links, ["own"]).select(F.col("id").alias(id_col), "class_id", "n_links")
