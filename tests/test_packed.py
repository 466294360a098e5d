"""Packed fields against a character-by-character reading, and the cases the docstrings define."""

import random

from strainloom.operators.packed import MARK, explode_packed


def brute(text):
    """Values of a packed text, read character by character (balanced quotes only)."""
    marks, quoted, i = [], False, 0
    while i < len(text):
        c = text[i]
        if not quoted and c == '"':
            quoted = True
            marks.append(("open", c))
        elif quoted and text[i : i + 2] in ('""', '\\"'):
            marks.append(("in", text[i : i + 2]))
            i += 1
        elif quoted and c == '"':
            quoted = False
            marks.append(("close", c))
        else:
            marks.append(("in" if quoted else "out", c))
        i += 1
    plain = "".join(c if k == "out" else "x" for k, c in marks)
    core = plain.strip(" \t\r\n")
    if core.startswith("[") and core.endswith("]") and core.count("[") == core.count("]") == 1:
        marks = marks[plain.index("[") + 1 : plain.rindex("]")]
    values, now = [], []
    for j, (k, c) in enumerate(marks):
        slash = c == "/" and k == "out" and 0 < j < len(marks) - 1 and marks[j - 1] == ("out", " ") and marks[j + 1] == ("out", " ")
        if k == "out" and (c in ",;|\t\r\n" or slash):
            values.append(now)
            now = []
        else:
            now.append((k, c))
    values.append(now)
    out = []
    for v in values:
        while v and v[0] in (("out", " "),):
            v = v[1:]
        while v and v[-1] in (("out", " "),):
            v = v[:-1]
        if v and v[0][0] == "open" and v[-1][0] == "close" and [k for k, _ in v].count("open") == 1:
            s = "".join(c[-1] for _, c in v[1:-1]).strip()
        else:
            s = "".join(c for _, c in v)
        if s:
            out.append(s)
    return out


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id long, f string")
    got = {i: [] for i in range(len(texts))}
    for r in sorted(explode_packed(df, "row_id", ["f"]).collect(), key=lambda r: (r.row_id, r.pos)):
        got[r.row_id].append(r.item)
        assert r.pos == len(got[r.row_id])
    return [got[i] for i in range(len(texts))]


CASES = {
    'a=1; b=2 ,c | d\te\nf / g': ["a=1", "b=2", "c", "d", "e", "f", "g"],
    '"x, y";"""Blue"" tube 4" , "\\"Old\\" one"': ["x, y", '"Blue" tube 4', '"Old" one'],
    "[TT-1 / QT/35/25]": ["TT-1", "QT/35/25"],
    '["rough / O-neg"; a]': ["rough / O-neg", "a"],
    "[a], [b]": ["[a]", "[b]"],
    "tet[a]": ["tet[a]"],
    " ; ,, |": [],
    "": [],
    "a,a,a": ["a", "a", "a"],
    'lone " mark, b': ['lone " mark', "b"],
    f"keeps {MARK}0{MARK} own, \"q;\"": [f"keeps {MARK}0{MARK} own", "q;"],
    '"" , "z"': ["z"],
}


def test_cases(spark):
    assert run(spark, list(CASES)) == list(CASES.values())


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 3)], "row_id long, f string, item string, pos int")
    assert explode_packed(df, "row_id", ["f"]).count() == 0
    assert [r.item for r in explode_packed(df, "row_id", ["f", "item"]).collect()] == ["x"]
    assert explode_packed(df.where("false"), "row_id", ["f"]).count() == 0


def test_very_long_text(spark):
    long = ";".join(f'"v{i}, w"' for i in range(60_000))
    got = run(spark, [long, '"' + "y" * 2_000_000 + '"', '"' * 2_001])
    assert len(got[0]) == 60_000 and got[0][-1] == "v59999, w"
    assert got[1] == ["y" * 2_000_000]
    assert got[2] == ['"' * 2_001]  # the first mark has no partner, so the text is no quoted value and stays as it is


VALUES = ['"a, b"', '"""q"" r"', '"\\"s"', "plain", "x/y", '" "', "[", "]", "", "k=[v]"]
DELIMS = [" / ", ";", ", ", " |", "\n", "\t", ",,"]


def test_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(600):
        body = "".join(rng.choice(VALUES) + rng.choice(DELIMS) for _ in range(rng.randrange(9)))
        texts.append(rng.choice(["", " ", "["]) + body + rng.choice(["", "x", "]"]))
    for text, got, want in zip(texts, run(spark, texts), [brute(t) for t in texts]):
        assert got == want, text
