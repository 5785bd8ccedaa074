import random

import pytest

from conftest import dicts
from sedgework.llm import scanned as S

SCHEMA = "kind string, id string, file string, line long, text string, heading boolean, defect string"
LEXICON = "pressure section calibration document technician humidity reviewer schedule container membrane alarm number complete winch turbidity".split()


def prose(rng, n):
    return " ".join(rng.choices(LEXICON, k=n)).capitalize() + "."


def corpus(rng):
    """Frequent words for the vocabulary."""
    return [("chunk", f"v{i}", "/v.md", i * 10, prose(rng, 60), False) for i in range(30)]


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = [(r["id"], r["defect"]) for r in dicts(S.defects(df)) if not (r["id"] or "").startswith("v")]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("line", ["– 29 –", "- 3 -", "Page 3 of 9", "Seite 12", "第 8 頁", "p. 4", "[17]", "· 9 ·", "26 / 41", "37", "   5"])
def test_page_numbers(line):
    assert S.judge(f"a line of words that\n{line}\ngoes on here.")[1].kind == "pageno"


@pytest.mark.parametrize("line", ["2023.", "12 of the", "see page 4 now", "[17] says", "3 cups", "section 2.3"])
def test_no_page_numbers(line):
    assert "pageno" not in [x.kind for x in S.judge(f"a line of words that\n{line}\ngoes on here.")]


def test_numbers_in_code_are_content():
    assert {x.kind for x in S.judge("```\n12\n5\n```")} == {"text"}


HEAD = "Draft Rev. 7.1 – Transcript of it – Sheet {}"


def test_headers_by_form_and_by_repetition(spark):
    rng = random.Random(1)
    page = lambda head: f"Some words of a paragraph that are cut off by the\n{head}\nfurniture of a page and then go on for a while."
    rows = corpus(rng) + [
        ("parent", "form", "/a.md", 1, page(HEAD.format(1)), False),
        ("parent", "t1", "/b.md", 1, page("Valve and pump"), False),
        ("parent", "t2", "/b.md", 40, page("Valve and pump"), False),
        ("parent", "plain", "/c.md", 1, "Some words of a paragraph.\n\nAnother line\n\n- item\n- item", False),
        ("parent", "h", "/d.md", 1, "# Valve and pump\ntext of the section", True),
    ]
    assert found(spark, rows) == {("form", "header"), ("t1", "header"), ("t2", "header")}


@pytest.mark.parametrize("mark", ["-", "\u2010", "\u00ac", "\u00ad", "- "])
def test_words_carried_over(spark, mark):
    rows = [("parent", "a", "/a", 1, f"the calib{mark}\nration of it", False), ("parent", "b", "/a", 9, "a - b\n- c\nx -\ny", False)]
    assert found(spark, rows) == {("a", "hyphen")}


def test_words_carried_over_furniture(spark):
    text = "each humidity in the schedule of the calib-\n26 / 41\n" + HEAD.format(2) + "\nration next to the container was reviewed again."
    assert found(spark, [("parent", "a", "/a", 1, text, False)]) == {("a", "hyphen"), ("a", "pageno"), ("a", "header")}


BAD = ["prcssure", "secti0n", "ca1ibration", "clocument", "cliecksum", "humiclity", "rev!ewer", "sche†ule", "c@librati0n", "alarrn", "nurnber", "winc1i"]


def test_misread_words(spark):
    rng = random.Random(2)
    good = {"prcssure", "secti0n", "ca1ibration", "humiclity", "rev!ewer", "c@librati0n", "alarrn", "nurnber", "tur6idity", "mernbrane"}
    rows = corpus(rng) + [("parent", w, "/a", 1, f"the {w} of it", False) for w in good]
    fine = ["B18", "step_9", "c9d9cd9f", "valve5/x", "http://a1b.c", "pressure!", "unknowable", "2023", "LB-9", "section 12"]
    rows += [("parent", w, "/a", 1, f"the {w} of it", False) for w in fine]
    assert found(spark, rows) == {(w, "chars") for w in good}


def test_misread_cjk(spark):
    rows = [("chunk", f"v{i}", "/v", i, "濕度部分記錄後，由容器量測流量。", False) for i in range(40)]
    assert found(spark, rows + [("parent", "a", "/a", 1, "若容噐量測", False), ("parent", "b", "/a", 2, "若容器量測", False)]) == {("a", "chars")}


def test_anagram_differences_reach_exactly_the_exchanges():
    for bad, good, want in [("rnodern", "modern", True), ("c1ear", "clear", True), ("cleer", "clear", False), ("m0dem", "modern", False), ("abc", "abc", False)]:
        assert S.reaches(bad, good) is want


def test_repaired_text(spark):
    rng = random.Random(3)
    rows = corpus(rng) + [("chunk", f"w{i}", "/w.md", i, "the stand-alone pump", False) for i in range(5)]
    text = "# Head\n\nThe prcssure of the stand-\nalone pump and the calib-\n– 7 –\nration of it.\n\n- one item\n- two\n\n```\ncode  a\n12\n```\n\nNext para-\ngraph"
    df = spark.createDataFrame([(*r, "x") for r in [*rows, ("parent", "a", "/a", 1, text, True), ("parent", "a", "/a", 1, text, True)]], SCHEMA)
    got = {r["id"]: r["repaired"] for r in dicts(S.repaired(df))}
    assert got == {
        "a": "# Head\n\nThe pressure of the stand-alone pump and the calibration of it.\n\n- one item\n- two\n\n```\ncode  a\n12\n```\n\nNext paragraph"
    }


def test_nulls_empty_and_long(spark):
    rows = [("parent", "n", None, None, None, False), ("parent", None, "/a", 1, "x-\ny", False), ("parent", "e", None, None, "", None), ("parent", "l", None, 1, "word " * 60_000, None)]
    assert found(spark, rows) == set() and found(spark, []) == set()
    assert S.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_two_exchanges_of_any_confusable_places(spark):
    words = [("rcccived", 1), ("received", 50), ("囘峙", 1), ("回時", 50), ("h0u5", 1), ("hous", 50), ("clerc", 1), ("clere", 2)]
    got = S.corrections(spark.createDataFrame(words, "word string, n long"))
    assert {r["bad"]: r["good"] for r in dicts(got)} == {"rcccived": "received", "囘峙": "回時", "h0u5": "hous"}


def test_headers_come_from_page_edges_that_repeat(spark):
    """No form is asked of a line that breaks sentences at two places of its file, however long it is."""
    odd = "annex 7 of the very long and wholly unusual running title that no list of forms and no limit of words or of characters would know, part b"
    page = lambda k: f"The quick sensor number {k} was compared with the\nolder unit and the result was noted in the\n{odd.replace('7', str(k))}\nbook of the laboratory by the night shift and\nits staff.\n"
    rows = [("parent", f"p{k}", "/f.md", 10 * k, page(k), False) for k in range(3)] + [("parent", "q", "/g.md", 1, page(9), False)]
    df = spark.createDataFrame(rows, "kind string, id string, file string, line long, text string, heading boolean")
    found = {(r["id"], r["defect"]) for r in dicts(S.defects(df))}
    assert {i for i, d in found if d == "header"} == {"p0", "p1", "p2"}


def test_a_word_without_a_frequent_variant_is_left_alone(spark):
    df = spark.createDataFrame([("parent", "a", "/f", 1, "the zqv0rtex and the zqv0rtex", False)], "kind string, id string, file string, line long, text string, heading boolean")
    assert S.defects(df).count() == 0


def test_bad_words_too_many_for_a_bitmap_are_joined(spark, monkeypatch):
    from sedgework.llm import neardup

    rows = [("parent", f"p{i}", "/f", i, "the valve is closed by the valve wheel", False) for i in range(8)] + [("parent", "x", "/f", 99, "the va1ve is closed", False)]
    df = spark.createDataFrame(rows, "kind string, id string, file string, line long, text string, heading boolean")
    want = sorted(map(tuple, S.defects(df).collect()))
    monkeypatch.setattr(neardup, "MOST_FILTER_BITS", 1)
    assert sorted(map(tuple, S.defects(df).collect())) == want == [("parent", "x", "chars")]
