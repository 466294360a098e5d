"""Containers, mixes and look-alike texts."""

import random
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strainloom.llm.lookalike import Trie, by_table, canonical_texts, look_alike_classes, look_alike_pairs
from strainloom.llm.mixing import mix_sources, repetition_rates, shares_reached
from strainloom.llm.packing import best_fit, pack_documents
from strainloom.llm.tokens import n_tokens


def test_best_fit_respects_conflicts():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 60) for _ in range(900)), reverse=True)
    sources, clusters = [rng.randrange(9) for _ in sizes], [rng.choice([-1, -1, rng.randrange(40)]) for _ in sizes]
    for slack, fill in ((0.02, 0.97), (None, 0.96)):
        boxes = best_fit(sizes, sources, clusters, 100, slack)
        used, met = Counter(), set()
        for s, c, b in zip(sizes, clusters, boxes):
            used[b] += s
            assert c < 0 or (c, b) not in met
            met.add((c, b))
        assert max(used.values()) <= 100 and sum(sizes) / (100 * len(used)) > fill
    assert len(set(zip(sources, boxes))) == len(sizes)  # without a slack no source meets itself


def test_search_goes_on_to_the_tightest_compatible_container():
    # rooms of 10, 20 and 50 are open; the item of 8 fits none of the tighter two
    assert best_fit([90, 80, 50, 8], [0, 1, 2, 0], [-1, 7, -1, 7], 100) == [0, 1, 2, 2]
    assert best_fit([90, 80, 50, 8], [0, 1, 2, 0], [-1, 7, -1, 7], 100, 0.02) == [0, 1, 2, 0]
    assert best_fit([90, 90, 8], [0, 0, 0], [-1, -1, -1], 100) == [0, 1, 2]


def test_pack_documents(spark):
    rows = [(1, 9000, "a", "t"), (2, 4096, "a", "t"), (3, 0, "a", None), (4, None, "b", None), (5, 100, None, "t"), (6, 100, "b", "t"), (7, 100, "b", None), (7, 100, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, source string, cluster string")
    got = pack_documents(df, "doc_id", "n_tokens", F.col("source"), F.col("cluster"), 4096).collect()
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.piece, r.token_from, r.token_to))
    assert sorted(spans[1]) == [(0, 0, 4096), (1, 4096, 8192), (2, 8192, 9000)]
    assert 3 not in spans and 4 not in spans and len(spans[7]) == 2
    boxes = {r.doc_id: r.container for r in got}
    assert boxes[5] != boxes[6]
    assert pack_documents(df.where("false"), "doc_id", "n_tokens", F.col("source"), F.col("cluster"), 4096).count() == 0


@pytest.mark.parametrize("share,over", [(0.12, 1.06), (0.2, 1.1)])  # half as many documents as containers, and more
def test_hot_source_leaves_little_room(spark, share, over):
    """Sources never meet, and containers are few beside what the tokens, or the documents of one source, ask for."""
    rng = random.Random(9)
    rows = [(i, min(4096, int(rng.lognormvariate(6.1, 1.0)) + 1), "hot" if rng.random() < share else f"s{rng.randrange(20)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, source string")
    got = pack_documents(df, "doc_id", "n_tokens", F.col("source"), F.lit(None).cast("string"), 4096)
    boxes = got.groupBy("container").agg(F.sum("n_tokens").alias("used")).collect()
    assert got.where("source_again").count() == 0 and max(r.used for r in boxes) <= 4096
    bound = max(sum(r[1] for r in rows) / 4096, sum(r[2] == "hot" for r in rows))
    assert len(boxes) < over * bound


def test_mix(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id < 60 then 'small' when id % 7 = 0 then null else 'mid' end as source", "if(id = 5, null, 10) as n_tokens", "1 as size")
    targets = spark.createDataFrame([("hot", 0.3, 2), ("small", 0.1, 3), ("mid", 0.5, 2), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(docs, targets, "doc_id", "n_tokens")
    shares = {r.source: r for r in shares_reached(mixed, repetition_rates(docs, targets, "n_tokens")).collect()}
    assert shares["gone"].n_rows == 0 and shares[None].n_rows == 0
    assert shares["small"].n_rows == 3 * docs.where("source = 'small'").count()
    assert abs(shares["hot"].share / shares["mid"].share - 0.6) < 0.04
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] == 3
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mix_sources(docs.repartition(7), targets, "doc_id", "n_tokens").collect()))
    assert mix_sources(docs.where("false"), targets, "doc_id", "n_tokens").count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Good evening."), (2, None), (3, ""), (4, "word " * 60_000)], "id long, text string")
    got = {r.id: r.n for r in df.select("id", n_tokens(F.col("text")).alias("n")).collect()}
    assert got[2] == got[3] == 0 and got[1] == 3 and got[4] >= 60_000


PLAIN = ["La boîte est près du marché, 12 fois.", "Последний паром не нашёл ящик", "Ο κήπος είναι Νέος", "the cop is next to a pea", ""]


def disguise(text, rng):
    back = defaultdict(list)
    for c in map(chr, [*range(0x370, 0x530), *range(0xFF10, 0xFF5B)]):
        if len(by_table(c)) == 1 and by_table(c) != c:
            back[by_table(c)].append(c)
    out = []
    for c in unicodedata.normalize("NFD", text) if rng.random() < 0.5 else text:
        alike = back.get(by_table(c), [])
        out.append(rng.choice([" ", " "]) if c == " " and rng.random() < 0.3 else rng.choice(alike) if alike and rng.random() < 0.4 else c)
        if rng.random() < 0.1:
            out.append(rng.choice("​­﻿͏"))
    return "".join(out)


def test_look_alikes_against_table(spark):
    rng = random.Random(2)
    texts = PLAIN + PLAIN[:2] + [disguise(t, rng) for t in PLAIN for _ in range(6)] + ["the Cop is next to a pea", "the  cop is next to a pea", "the cop is next to a péa", None, "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("canonical", F.lit(1))
    got = {(r.doc_a, r.doc_b) for r in look_alike_pairs(df, "doc_id", "text").collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and a is not None and b is not None and a != b and by_table(a) == by_table(b)}
    assert len(want) > 60 and got == want
    forms = {r.doc_id: r.canonical for r in canonical_texts(df, "doc_id", "text").collect()}
    assert all(forms[i] == t for i, t in enumerate(PLAIN))
    assert look_alike_pairs(df.where("false"), "doc_id", "text").count() == 0


# Written by hand: texts of one number look the same, all others differ.
SAME_LOOK = [
    (1, "The final office"), (1, "The ﬁnal oﬃce"), (1, "The fi\u200bnal office"), (1, "Тhe final оffice"), (1, "Ｔｈｅ\u00a0final\u2009office"), (1, "The ﬁnal o\ufb00ice"),
    (2, "ﬂuﬀy"), (2, "fluffy"), (2, "ｆluffу"), (3, "best"), (3, "be\ufb06"), (3, "beﬅ"),
    (4, "сор"), (4, "cop"), (4, "сοp"), (5, "Cop"), (6, "c0p"), (7, "café"), (7, "cafe\u0301"), (7, "сafé"), (8, "cafe"), (9, "ΝΕΟ"), (9, "NEO"), (10, "Nεο"), (11, "the  cop"), (12, "the cop"), (13, "the\ncop"), (12, "the\u3000cop"), (14, "l"), (15, "I"), (16, "1"),
    (17, "привет"), (17, "пpивeт"), (17, "приве\u00adт"), (18, "cop."), (19, "cop，"), (20, "ﬁ"), (20, "fi"), (21, "f i"),
]


def test_looks_written_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(SAME_LOOK)], "doc_id long, text string")
    want = {(i, j) for i, (a, x) in enumerate(SAME_LOOK) for j, (b, y) in enumerate(SAME_LOOK) if i < j and a == b and x != y}
    got = [(r.doc_a, r.doc_b) for r in look_alike_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    least = {}
    for i, (a, _) in enumerate(SAME_LOOK):
        least.setdefault(a, i)
    links = {i: sum(i in p for p in want) for i in range(len(SAME_LOOK))}
    assert {(r.doc_id, r.class_id, r.n_links) for r in look_alike_classes(df, "doc_id", "text").collect()} == {(i, least[a], links[i]) for i, (a, _) in enumerate(SAME_LOOK) if links[i]}


def test_automaton_weighs_edits():
    trie = Trie()
    for word, n in (("cop", 3), ("сор", 9), ("corps", 1), ("fine", 2)):
        trie.add(word, n)
    assert sorted(w[3] for w in trie.walk("сop")) == ["cop", "сор"] and min(trie.walk("сop"))[3] == "cop"
    assert [w[3] for w in trie.walk("ﬁ\u200dnе")] == ["fine"] and trie.walk("c0p") == [] and trie.walk("copy") == []
    assert min(trie.walk("c0p", 1.0))[0] == 1.0 and {w[3] for w in trie.walk("ccp", 1.0)} == {"cop", "сор"}
    assert {w[3] for w in trie.walk("corp", 1.0)} == {"cop", "сор", "corps"}


def test_hot_look_among_copies(spark):
    """A third of all documents are copies of one text; only its look-alikes make pairs with them."""
    df = spark.range(600).selectExpr("id as doc_id", "if(id % 3 = 0, if(id < 6, 'с\u043ep', 'cop'), concat('n', id)) as text")
    assert look_alike_pairs(df, "doc_id", "text").count() == 2 * 198
    assert look_alike_classes(df, "doc_id", "text").count() == 200
