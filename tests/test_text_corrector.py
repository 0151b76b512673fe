"""Spelling over relations against a plain version, text by text."""

import random
import re

from vellum.operators import text_corrector
from vellum.operators.text_corrector import LETTERS, correct_text

KNOWN = {"the": 90, "document": 30, "is": 50, "small": 20, "smell": 20, "ab": 3, "abab": 2, "été": 7, "washington": 4, "stone": 5, "tone": 5}


def near(word: str, known: dict[str, int]) -> str:
    low = word.lower()
    if low in known or (word == word.upper() and len(word) <= 4):
        return word

    def one_edit(t: str) -> bool:
        if abs(len(t) - len(low)) > 1:
            return False
        start = next((i for i, (x, y) in enumerate(zip(low, t, strict=False)) if x != y), min(len(low), len(t)))
        return low[start + 1 :] == t[start + 1 :] or low[start:] == t[start + 1 :] or low[start + 1 :] == t[start:]

    found = sorted((-n, t) for t, n in known.items() if one_edit(t))
    if not found:
        return word
    t = found[0][1]
    return t.upper() if word == word.upper() and len(word) > 1 else t[:1].upper() + t[1:] if word[0] == word[0].upper() else t


def plain(text: str | None, known: dict[str, int]) -> tuple:
    if text is None:
        return None, 0, 0
    changed = 0

    def fix(m):
        nonlocal changed
        new = near(m[0], known)
        changed += new != m[0]
        return new

    text = re.sub(LETTERS, fix, text)
    tokens, out, i, merges = re.findall(r"[^ \t\n\x0b\f\r]+", text), [], 0, 0
    while i < len(tokens):
        pair = tokens[i : i + 2]
        if len(pair) == 2 and "".join(pair).lower() in known and not all(t.lower() in known for t in pair):
            out.append("".join(pair))
            merges, i = merges + 1, i + 2
        else:
            out.append(tokens[i])
            i += 1
    return (" ".join(out) if merges else text), changed, merges


def check(spark, texts, known=KNOWN):
    rows = [(i % 5, i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "pos int, id int, text string, corrected string")
    got = {r.id: r for r in correct_text(docs, spark.createDataFrame([*known.items()], "term string, frequency int")).collect()}
    assert len(got) == len(rows)
    for pos, i, t, x in rows:
        r = got[i]
        assert (r.corrected_text, r.n_corrections, r.n_merges) == plain(t, known), t
        assert r.n_changes == r.n_corrections + r.n_merges and (r.pos, r.corrected) == (pos, x)


def test_edges(spark):
    check(
        spark,
        [None, "", "  ", "the docu ment\tis smal", "Teh SMALLL  docs.", "WASH INGTON, WASH INGTON", "wash\n\nington", "a bab a bab", "xstone", "été ete", "no words 123", "docu ment docu ment ment", "$1 \\ smal"],
    )
    check(spark, ["the docu ment"] * 300)


def test_random(spark):
    r = random.Random(3)
    parts = [*KNOWN, "smal", "docu", "ment", "WASH", "ington", "Teh", "x", "ba", "tones.", "thé", "12"]
    check(spark, [r.choice(["", " "]).join(r.choice(parts) + r.choice([" ", "  ", "\n", ", "]) for _ in range(r.randrange(60))) for _ in range(150)])


def test_long_text(spark):
    check(spark, ["the smal docu ment " * 20_000])


def test_no_dictionary(spark):
    docs = spark.createDataFrame([(1, "smal docu ment"), (1, "smal docu ment"), (2, None)], "id int, text string")
    out = correct_text(docs, spark.createDataFrame([], "term string, frequency int")).collect()
    assert sorted((r.id, r.corrected_text, r.n_changes) for r in out) == [(1, "smal docu ment", 0), (1, "smal docu ment", 0), (2, None, 0)]


def test_bitmaps_leave_out_words_before_they_are_dealt_out(spark):
    known = spark.createDataFrame([(f"term{i}",) for i in range(200)], "_t string")
    rows = spark.createDataFrame([(i, f"term{i}") for i in range(100, 3000)], "id int, t string")
    found = {r.id for r in text_corrector._likely(rows, "t", known, "_t").collect()}
    assert set(range(100, 200)) <= found and len(found) < 200
    assert text_corrector._likely(rows, "t", known.limit(0), "_t").count() == 0
    texts = spark.createDataFrame([(b"k", "a b term 1 c d")], "_k binary, _text string")
    plan = text_corrector._merges(texts, known)._jdf.queryExecution().optimizedPlan().toString()
    assert "_ones" in plan and "LeftSemi" not in plan  # a semi join would go below the bitmap
    assert [r._at for r in text_corrector._merges(texts, known).collect()] == [[2]]


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(text_corrector, "BITS", 64)
    check(spark, ["the docu ment\tis smal", "Teh SMALLL  docs.", "wash\n\nington", None, "xstone docu ment ment"])
