import pytest

from conftest import dicts
from sedgework.llm import truncation as T

SENTENCE = "The quick technician compared the humid container with the older one and noted the result."


@pytest.mark.parametrize(
    "text, state",
    [
        ("A whole sentence.", "plain ."), ("文が終わる。", "plain 。"), ("Really?", "plain ?"), ("Yes! \u200b\n", "plain !"), ("He said “done.”", "plain ."),
        ("(An aside.)", "plain ."), ("index, centrifuge, etc.", "plain ."), ("all of it ...\n\n— end of file —", "framed —"), ("```\ncode\n```", "whole"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", "whole"), ("- item", "item w"), ("# Title", "heading w"), ("Text.\n\nRef: /srv/kb/notes/9.md", "path w"),
        ("Text.\n\nSigned: the night shift, bench 17", "words"), ("It was remotel", "plain w"), ("With a polymer,", "plain ,"), ("then the …", "cut"), ("the th…", "cut"),
        ("Part 7: it is done here. Nothing mo", "plain w"), ("- it is done. Nothing mo", "plain w"),
        ("the h...", "cut"), ("in t\ufffd", "cut"), ("```\ncode", "cut"), ("| a | b |\n|---|---|\n| 1", "cut"), ("| a | b |\n|---|---|\n| 1 |", "cut"),
        ("Text. [link](../notes/6", "cut"), ("Text. (Each one is here.", "cut"), ("Text. “Each one is here.", "cut"), ("", "blank"), (None, "blank"), (" \n", "blank"),
    ],
)
def test_endings(text, state):
    got, what = T.ending(text)
    assert (what if got == "unit" else got) == state


def test_units_are_counted_by_paragraph():
    counts = {}
    for unit, ends, inside in T.units("# One\n\nIt is here. It, too.\n- a b\n- c\n\nThe last paragr"):
        e, n = counts.get(unit, (0, 0))
        counts[unit] = (e + ends, n + inside)
    assert counts == {"heading w": (1, 0), "heading #": (0, 1), "plain .": (0, 2), "plain w": (0, 2), "plain ,": (0, 1), "item w": (1, 2), "item -": (0, 2)}


def test_terminality_is_learned_from_the_corpus(spark):
    """A mark that the prior does not know becomes an ending where the corpus ends paragraphs with it."""
    usual = [(f"Number {i} is here ;\n\nAnd so is another {i} ;\n\nThis one, too {i} ;", "a") for i in range(40)]
    never = [(f"Here {i} ; and there ; and on ; and on ; and on.\n\nIt is done {i}.", "a") for i in range(40)]
    assert not any(judged(spark, usual)[1].values())
    assert judged(spark, never + [("It goes on ;", "a")])[1] == {i: i == 40 for i in range(41)}


def test_alignment():
    text = " ".join(f"{SENTENCE} {i}" for i in range(12))
    assert T.ends_early(text[:-40], text) == -1 and T.ends_early(text, text[:-40]) == 1
    assert T.ends_early(text, text) == 0 and T.ends_early("alpha " * 30, text) == 0
    assert T.ends_early(text + " extra ending", text.replace("older", "elder", 1)) == 1
    assert T.ends_early(text[: text.rindex(".")], text) == -1, "the stop is missing"
    assert T.ends_early(text[: text.rindex(".") + 1], text) == 0, "between sentences"


@pytest.mark.parametrize("share", [0.9, 0.75, 0.6, 0.4])
def test_a_copy_may_be_cut_to_any_part(share):
    words = [f"word{i}" for i in range(200)]
    part = " ".join(words[: int(200 * share)])
    assert T.ends_early(part, " ".join(words)) == -1 and T.ends_early(part[:-2], " ".join(words)) == -1


def test_alignment_finds_cut_copies_that_their_endings_do_not_show(spark):
    items = "\n".join(f"- part {i} of the {i * 7} pieces in box {i * 3}" for i in range(40))
    rows = [(items, "a"), (items[: int(len(items) * 0.6)].rsplit(" ", 2)[0], "a"), ("\n".join(items.split("\n")[:30]), "b")]
    got = judged(spark, rows)[1]
    assert got[0] is False and got[1] is True


def judged(spark, rows):
    df = spark.createDataFrame([(i, t, s, "x") for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, truncated string")
    return df, {r["doc_id"]: r["truncated"] for r in dicts(T.judged(df))}


def test_copies_decide_about_items(spark):
    whole = " ".join(f"{SENTENCE} {i}." for i in range(10)) + "\n\n- first thing\n- second thing\n- third thing"
    rows = [(whole, "a"), (whole[:-15], "a"), (whole[:-15], "b"), ("Other text.\n\n- an item", "a"), (whole.split("\n")[0], "b")]
    assert judged(spark, rows)[1] == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_closing_words_are_learned(spark):
    rows = [(f"Text {i}.\n\nSigned: the night shift, bench {i}", "a") for i in range(4)] + [("Text.\n\nSigned: the nig", "a"), ("Text.\n\nSigned: the nig", "a")]
    assert judged(spark, rows)[1] == {0: False, 1: False, 2: False, 3: False, 4: True, 5: True}, "a text and its copy are one witness"


def test_rates(spark):
    rows = [("It was cut of", "a"), ("It was cut at", "a"), ("Whole.", "a"), (None, "a"), ("", "b"), ("cut he", None)]
    got = {r["source"]: r for r in dicts(T.rates(T.judged(judged(spark, rows)[0])))}
    assert (got["a"]["documents"], got["a"]["truncated"], got["a"]["rate"], got["a"]["usual_length"]) == (4, 2, 0.5, 13)
    assert got["b"]["rate"] == 0 and got[None]["truncated"] == 1 and got[None]["usual_length"] is None
    assert T.judged(judged(spark, rows)[0].limit(0)).count() == 0


def test_very_long_text(spark):
    assert judged(spark, [("word " * 100_000, "a"), ("word " * 100_000 + "end.", "a")])[1] == {0: True, 1: False}
