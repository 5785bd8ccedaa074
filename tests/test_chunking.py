import random

import pytest

from conftest import dicts
from sedgework.operators import chunking as C


def flat(text):
    return [(b.first, b.last) for b in C.flat_windows(text)]


def test_flat_windows():
    line = "some words on a line"
    assert flat("\n".join([line] * 3)) == [(1, 3)] and flat("tiny") == [] and flat("") == []
    spans = flat("\n".join([line] * 120))
    assert spans[0][0] == 1 and spans[-1][1] == 120 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    assert flat("\n".join([line] * 44 + [""] + [line] * 35))[0] == (1, 45)
    assert flat("\n".join([line] * 28 + ["", line])) == [(1, 29)], "the search runs on a short last window, the rest is too small"


def tree(text):
    parents, children = C.markdown_tree(text)
    return [(b.first, b.last, h) for b, h in parents], [(b.first, b.last, p) for b, p in children]


def test_sections_and_preamble():
    parents, children = tree("a preamble line\n\n# One\ntext of the one\n\n## Two\n\nfirst block here\n\n## 三\n短い\n\n十文字以上の日本語の文です")
    assert [p[2] for p in parents] == [None, "One", "Two", "三"]
    assert children == [(1, 1, 0), (3, 4, 1), (8, 8, 2), (13, 13, 3)]


def test_fences():
    parents, children = tree("# T\n\n```\na = 1\n\nb = 2\n~~~\n\nafter the fence")
    assert children[0][:2] == (3, 7) and children[1][:2] == (9, 9)
    assert len(tree("# T\n\n```\nopen\n\nstill open")[1]) == 1
    assert [p[2] for p in tree("```\n# comment\n```")[0]] == [None, "comment"]


def test_odd_documents():
    assert tree("# Only a heading") == ([(1, 1, "Only a heading")], [])
    assert tree("") == ([(1, 1, None)], [])
    assert tree("## A\r\ntext") == ([(1, 2, None)], [(1, 2, 0)]), "a carriage return hides a heading"
    assert tree("# A\n\nshort\n\ntiny") == ([(1, 5, "A")], [(3, 3, 0)]), "a parent keeps its first block"
    assert tree("\n\n# A") == ([(1, 2, None), (3, 3, "A")], [])


def test_long_blocks_and_sections():
    assert [c[:2] for c in tree("# A\n" + "\n".join(["a line of text"] * 120))[1]] == [(1, 50), (51, 100), (101, 121)]
    text = "# A\n\n" + "\n\n".join(["\n".join(["a line of text"] * 40)] * 8)
    parents, children = tree(text)
    assert len(parents) == 2 and parents[0][0] == 1 and parents[-1][1] == len(text.split("\n"))
    assert {c[2] for c in children} == {0, 1}


@pytest.mark.parametrize("seed", range(8))
def test_every_line_with_text_belongs_to_a_parent(seed):
    rng = random.Random(seed)
    kinds = ["", "", "a line of text", "# Heading", "```", "~~~", "- item", "x"]
    lines = [rng.choice(kinds) for _ in range(rng.randint(0, 500))]
    parents, children = C.markdown_tree("\n".join(lines))
    covered = {i for b, _ in parents for i in range(b.first, b.last + 1)}
    assert all(i in covered for i, x in enumerate(lines, 1) if x.strip())
    for b, p in children:
        assert parents[p][0].first <= b.first and b.last <= parents[p][0].last


def test_rows_and_ids(spark):
    files = spark.createDataFrame([("/a.md", "# T\n\nenough text here", 1), ("/b.txt", "flat text that is long enough", 2), ("/n.md", None, 3)], "path string, text string, id int")
    chunked = C.chunk_files(files)
    kids = {r["file_path"]: r for r in dicts(C.child_rows(chunked, "now"))}
    mums = dicts(C.parent_rows(chunked, "now"))
    assert kids["/a.md"]["parent_id"] == mums[0]["id"] and kids["/a.md"]["line_start"] == 3 and kids["/b.txt"]["parent_id"] is None
    assert kids["/b.txt"]["tokens"] == 8 and len(mums) == 1
