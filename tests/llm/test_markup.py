import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import dicts
from sedgework.llm.markup import clean, clean_fields, content_of, from_html, from_latex, from_wiki, parse_html


@pytest.mark.parametrize(
    "text, kinds, want",
    [
        ("plain text, 3 < 20 and 85 > 19", [], None),
        ("queue[4] fixture; tmp_83_copy, 3 * 5 * 3, a_b_c", [], None),
        ("Cost: $ 35 to $ 256. C:\\bench\\34\\new, x", [], None),
        ("2023. The next\n15. Of all", [], None),
        ("A <b>bold</b> &amp; word<br/>next", ["html"], "A bold & word\nnext"),
        ("<ul><li>one</li><li>two</li></ul>", ["html"], "- one\n- two"),
        ("<h2>Head</h2><p>text</p>", ["html"], "## Head\n\ntext"),
        ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", ["html"], "a | b\n1 | 2"),
        ("<pre><code>a &lt; b</code></pre>", ["html"], "```\na < b\n```"),
        ("<!-- note -->x", ["html"], "x"),
        ("**bold** and *soft* `code` ~~gone~~ [l](u) ![i](p.png)", ["markdown"], "bold and soft code gone l i"),
        ("```py\n<b>kept</b> **kept**\n```", ["markdown"], "```py\n<b>kept</b> **kept**\n```"),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"], "a | b\n1 | 2"),
        ("* one\n* two", ["markdown"], "- one\n- two"),
        ("1. one\n2. two", ["markdown"], "1. one\n2. two"),
        ("> said", ["markdown"], "said"),
        ("'''b''' ''i'' [[a|shown]] [[c]]{{t|x=1}}", ["wiki"], "b i shown c"),
        ("== Head ==\nx", ["wiki"], "## Head\nx"),
        ('{| class="w"\n! a !! b\n|-\n| 1 || 2\n|}', ["wiki"], "a | b\n1 | 2"),
        ("\\section{Head}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\emph{e}\\cite{r}", ["latex"], "# Head\n- one\ne"),
        ("so $x_{1} = \\frac{1}{2}$ holds", ["latex"], "so $x_{1} = \\frac{1}{2}$ holds"),
        ("\\[ p = \\sum q_i \\]", ["latex"], "\\[ p = \\sum q_i \\]"),
        ("$$ a_1 + $b_{2}$ $$ and \\emph{x}", ["latex"], "$$ a_1 + $b_{2}$ $$ and x"),
        ("(see~\\ref{t:1}, 5\\,mm)", ["latex"], "(see, 5 mm)"),
        ("<i>a</i> **b** [[c]] \\emph{d}", ["html", "markdown", "wiki", "latex"], "a b c d"),
        ("a\r\n**b**\r\n", ["markdown"], "a\nb"),
        ("", [], ""),
        (None, [], None),
    ],
)
def test_clean(text, kinds, want):
    got, found = clean(text)
    assert found == kinds
    assert got == (text if want is None else want)


def test_page_keeps_its_main_text():
    links = "<nav><ul>" + "<li><a href=x>a link of the menu</a></li>" * 20 + "</ul></nav>"
    body = "<div id=main><div><p>" + "</p><p>".join(["A long paragraph of the article with many words in it."] * 8) + "</p></div></div>"
    page = f"<html><head><title>t</title><style>s</style></head><body>{links}{body}<div>{'<a href=y>f</a> ' * 9}</div></body></html>"
    text = clean(page)[0]
    assert text.count("A long paragraph") == 8 and "menu" not in text
    assert content_of(parse_html(page))[0].tag == "div"


def test_a_fragment_loses_its_menu_only():
    menu = "<ul>" + "".join(f"<li><a href=x>go {i}</a></li>" for i in range(9)) + "</ul>"
    prose = "<div class=note><p>A paragraph with <a href=y>a link</a> and many more words than that, to be read.</p></div>"
    listed = "<ul><li>one thing</li><li>another <a href=z>thing</a></li></ul>"
    text, kinds = clean("Before it all, some words.\n\n" + menu + prose + listed + "\nAfter it.")
    assert kinds == ["html"] and "go " not in text
    assert all(x in text for x in ("Before it all", "a link", "- one thing", "- another thing", "After it."))
    root, left_out = content_of(parse_html(menu + prose))
    assert root.tag == "#root" and len(left_out) > 0 and not content_of(parse_html(prose + listed))[1]


def test_density_is_measured_wherever_there_is_html_and_nothing_but_menus_is_lost(spark):
    import os
    import re

    data = "/root/testdata/sf0.01/parents.parquet"
    if not os.path.exists(data):
        pytest.skip("no tables here")
    through = 0
    for (content,) in spark.read.parquet(data).select("content").where("content like '%<%'").collect():
        root = parse_html(content)
        if root.tags:
            through += 1
            assert root.density > 0
            text, found = from_html(content)
            assert found and all(w in text for w in re.findall(r"[^\W\d_]{2,}", re.sub(r"<[^<>]*>|&\w+;", " ", content)))
    assert through > 10


def test_nesting_of_any_depth():
    assert from_latex("\\emph{" * 5000 + "x" + "}" * 5000)[0] == "x"
    assert from_latex("\\emph{a {b} \\textbf{c}} and \\emph{open\n{d}")[0] == "a {b} c and \\emph{open\n{d}"
    assert from_wiki("a {{" + "x {{" * 3000 + "z" + "}} y" * 3000 + "}}b {{open\n")[0] == "ab {{open\n"
    table = "<table><tr><td>" * 800 + "x" + "</td></tr></table>" * 800
    assert clean(table)[0] == "x" and clean("<ul><li>" * 900 + "x")[0].endswith("- x")


def test_deep_and_broken_pages():
    assert clean("<div>" * 3000 + "x" + "</p>" * 10)[0] == "x"
    assert clean("<b")[1] == [] and clean("</b>x")[0] == "x"
    assert clean("`" * 5000 + "*" * 5000 + "[" * 5000)[0] is not None


def test_many_formulas_take_no_quadratic_time():
    text = "so $x_{1}$ is \\emph{e} and " * 20_000
    assert clean(text)[0].count("$x_{1}$") == 20_000


def test_fields(spark):
    rows = [
        ("a", "# **H**\nplain", "**H**", "x"),
        ("b", "**no heading**", None, "x"),
        ("c", None, "<b>h</b>", "x"),
        ("a", "# **H**\nplain", "**H**", "x"),
        ("d", "# only", "only", "x"),
        (None, "", "", "x"),
    ]
    df = spark.createDataFrame(rows, "id string, content string, heading string, cleaned string")
    got = {(r["id"], r["field"]): (r["markup"], r["cleaned"]) for r in dicts(clean_fields(df))}
    assert got["a", "content"] == ([], "plain") and got["a", "heading"] == (["markdown"], "H")
    assert got["b", "content"][0] == ["markdown"] and ("b", "heading") not in got and ("c", "content") not in got
    assert got["c", "heading"] == (["html"], "h") and got["d", "content"] == ([], "") and got[None, "content"] == ([], "")
    assert clean_fields(df).count() == 10 and clean_fields(df.limit(0)).count() == 0


RESIDUE = "<p> </p> <ul><li> <a href=x> </a> &amp; ** ` [[ ]] {{ }} {| |- |} \\emph{ } $ \\[ \\] ``` ~~~ ''' == |a|b| |---|---| <body> <!-- word".split() + ["\n", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(RESIDUE)))
def test_any_residue_is_cleaned(parts):
    text, kinds = clean("".join(parts))
    assert isinstance(text, str) and set(kinds) <= {"html", "markdown", "wiki", "latex"}
    assert text.count("word") <= "".join(parts).count("word")
