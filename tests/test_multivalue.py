import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import dicts
from sedgework.operators import multivalue
from sedgework.operators.multivalue import SPELLING, Lattice, bare, pieces, split_values, stretch


def split(spark, *values, **k):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "path int, metadata string, value string")
    out = {}
    for r in sorted(dicts(split_values(df, "path", "metadata", **k)), key=lambda r: (r["path"], r["pos"])):
        out.setdefault(r["path"], []).append(r["value"])
        assert r["pos"] == len(out[r["path"]])
    return [out.get(i, []) for i in range(len(values))]


FIELDS = [
    ("a, b;c|d\te\nf", list("abcdef")),
    ("甲、乙，丙；丁", list("甲乙丙丁")),
    ("a / b/c / d", ["a", "b/c", "d"]),
    ('"x, y" ; "say ""hi"", you", z', ["x, y", 'say "hi", you', "z"]),
    ("operator's cup, 'p; q', operator's", ["operator's cup", "p; q", "operator's"]),
    ("“a、 b”、「c| d」", ["a、 b", "c| d"]),
    (" , ;; a ,, ", ["a"]),
    ("a, a, a", ["a", "a", "a"]),
    ('"open, b', ['"open', "b"]),
    ("meeting notes", ["meeting notes"]),
    ("  ", []),
    ("", []),
    (None, []),
    ('"  padded  "', ["padded"]),
    ("x / ", ["x"]),
    ("a\r\nb", ["a", "b"]),
]


def test_fields(spark):
    assert split(spark, *(f for f, _ in FIELDS)) == [want for _, want in FIELDS]


def test_a_column_teaches_which_marks_part(spark):
    column = ["5,502 kPa; x"] + ["a, b"] * 3 + ["plaque 5,502 kPa"] * 2 + ['"5,502 kPa"'] * 6
    assert split(spark, *column)[0] == ["5,502 kPa", "x"]  # the column knows the whole value better than its parts
    assert split(spark, *column)[1] == ["a", "b"]


def test_every_field_with_a_mark_goes_through_the_lattice(spark, monkeypatch):
    seen, decided = [], multivalue._decided
    monkeypatch.setattr(multivalue, "_decided", lambda fields, open_, *rest: seen.append(open_.count()) or decided(fields, open_, *rest))
    rows = split(spark, "a, b", "c", "d; e / f", None)
    assert rows == [["a", "b"], ["c"], ["d", "e", "f"], []] and seen == [2]


def segmentations(parts, marks, known, total, rates, reach):
    """By listing all of them: the share of each mark's partings, and the likelihood of each set of partings."""
    n, out = len(parts), {}
    for bits in itertools.product([0, 1], repeat=n - 1):
        cuts = [0, *(i + 1 for i, b in enumerate(bits) if b), n]
        weight = math.prod(rates.get(m, 0.5) if b else 1 - rates.get(m, 0.5) for m, b in zip(marks, bits))
        for a, b in zip(cuts, cuts[1:]):
            value = bare(stretch(parts, marks, a, b))
            spelled = math.exp(SPELLING * (sum(len(p.strip(multivalue._BLANK)) for p in parts[a:b]) + b - a - 1)) / (total + 1)
            n_known = known.get(value, 0) / (total + 1)
            if b - a == 1:
                weight *= 1 if not value else n_known or spelled
            else:
                weight *= spelled + (n_known if b - a <= reach + 1 else 0)
        out[bits] = weight
    whole = sum(out.values())
    return [sum(w for bits, w in out.items() if bits[i]) / whole for i in range(n - 1)], out


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.sampled_from(["a", "b", "", "cc", " d"]), min_size=1, max_size=6),
    st.lists(st.sampled_from(",;/"), min_size=5, max_size=5),
    st.dictionaries(st.sampled_from(["a", "b", "cc", "a,b", "b;a", "a,b;cc"]), st.floats(0.1, 9), max_size=6),
    st.integers(0, 3),
)
def test_lattice_is_the_sum_over_all_segmentations(parts, marks, known, reach):
    marks = "".join(marks[: len(parts) - 1])
    rates, total = {",": 0.3, ";": 0.8}, sum(known.values()) + 3
    lattice = Lattice(parts, marks, known, total, rates, reach)
    shares, likelihood = segmentations(parts, marks, known, total, rates, reach)
    assert lattice.expected()[1] == pytest.approx(shares)
    best = lattice.best()
    assert [v for v in best if v] == best
    assert "".join(best).replace(" ", "") == "" or max(likelihood.values()) > 0


def test_empty_table_and_long_text(spark):
    assert split(spark) == []
    assert split(spark, ", ".join(map(str, range(20_000)))) == [list(map(str, range(20_000)))]
