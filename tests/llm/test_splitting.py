import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import dicts
from sedgework.llm.splitting import merged, split_oversized, split_text


def check(text, limit, overlap):
    spans = split_text(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b, core in spans:
        assert 0 < b - a <= limit and 0 <= core - a <= overlap and (core < b)
    for (_, b, _), (_, _, core) in zip(spans, spans[1:]):
        assert core == b, "the new parts make up the text"
    return [text[a:b] for a, b, _ in spans]


@pytest.mark.parametrize("seed", range(25))
def test_pieces_cover_the_text_within_the_limit(seed):
    rng = random.Random(seed)
    parts = ["# H\n", "## H\n\n", "word ", "Sentence ends. ", "文が終わる。", "\n\n", "- item\n", "```\ncode\n\nmore\n```\n", "x" * 300, "\r\n", "| a | b |\n"]
    text = "".join(rng.choices(parts, k=rng.randint(1, 300)))
    check(text, rng.choice([50, 200, 1000]), rng.choice([0, 10, 40]))


def test_cuts_at_natural_boundaries():
    text = "\n\n".join(f"## Part {i}\n\n" + "A sentence of some length. " * 20 for i in range(10))
    for piece in check(text, 1300, 0):
        assert piece.startswith("## Part")
    assert all(p.rstrip().endswith(".") for p in check("A sentence of some length. " * 200, 500, 100))


def test_code_is_kept_whole_where_it_fits():
    code = "```\n" + "line of code\n\n" * 10 + "```"
    text = ("Words and words. " * 30 + "\n\n" + code + "\n\n") * 4
    assert sum(code in p for p in check(text, 900, 0)) == 4


def test_rows(spark):
    rows = [("a", "x" * 5001, 1), ("a", "x" * 5001, 1), ("b", "x" * 4000, 1), ("c", None, 1), ("d", "", 1), ("e", "語" * 4001, 1)]
    df = spark.createDataFrame(rows, "id string, content string, piece int")
    got = dicts(split_oversized(df, "id", "content", 4000, 200))
    assert {r["id"] for r in got} == {"a", "e"} and len(got) == 4
    assert all(r["pieces"] == 2 and len(r["content"]) <= 4000 for r in got)
    assert split_oversized(df.limit(0), "id", "content", 10, 2).count() == 0


PARTS = ["# H\n", "word ", "a. ", "。", "\n\n", "- i\n", "```\n", "~~~\n", "x", "\n", "| a |\n", " "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1), st.integers(2, 40), st.data())
def test_any_text_is_covered(parts, limit, data):
    check("".join(parts), limit, data.draw(st.integers(0, limit - 1)))


PROSE = "A sentence of some length is here. "


def test_headings_stay_with_what_they_head_and_siblings_apart():
    text = "# A\n\n" + PROSE * 150 + "\n\n## B\n\nShort.\n\n# C\n\n" + PROSE * 3
    pieces = check(text, 2000, 0)
    assert pieces[0].startswith("# A\n\nA sentence") and len(pieces[0]) > 1000
    assert pieces[-1].startswith("# C") and pieces[-2].startswith("## B"), "not merged across a node that was cut"
    assert [p for p in pieces if p.lstrip().startswith("#")] == [pieces[0], *pieces[-2:]]


def test_a_title_goes_with_its_first_section():
    text = "# T\n\n" + "".join(f"## S{i}\n\n" + PROSE * 40 + "\n\n" for i in range(3))
    pieces = check(text, 1500, 0)
    assert [p.split("\n")[0] for p in pieces] == ["# T", "## S1", "## S2"]


def test_list_items_are_kept_whole_with_what_is_nested_in_them():
    item = "- " + PROSE * 3 + "\n" + "".join(f"  - {PROSE}\n    and on\n" for _ in range(4))
    pieces = check("Intro.\n\n" + item * 12, 700, 0)
    assert all(p.lstrip().startswith(("Intro", "- ")) for p in pieces) and not any("\n    and on" not in p and p.startswith("  ") for p in pieces)
    small = check(item * 3, 200, 0)
    assert all(p.startswith(("- ", "  - ", PROSE[:5])) for p in small)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(30, 80))
def test_merging_leaves_no_two_neighbours_that_fit(sizes, limit):
    marks = [0]
    for n in sizes:
        marks.append(marks[-1] + n)
    got = merged(list(zip(marks, marks[1:])), limit)
    assert got[0][0] == 0 and got[-1][1] == marks[-1] and all(x[1] == y[0] for x, y in zip(got, got[1:]))
    assert all(b - a <= limit for a, b in got) and all(y[1] - x[0] > limit for x, y in zip(got, got[1:]))
