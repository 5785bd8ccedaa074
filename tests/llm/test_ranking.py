import random

import pytest

from conftest import dicts
from sedgework.llm import ranking as R

SCHEMA = "search_id long, chunk_id string, bm25 double, vector double, rerank double, hybrid double, percentiles string"
NAN = float("nan")


def brute(rows):
    """Order of each search, by plain sorting."""
    table = {}
    for s, c, *scores in rows:
        own = table.setdefault(s, {}).setdefault(c, [None] * 4)
        for i, x in enumerate(scores[:4]):
            if x is not None and x == x:
                own[i] = x if own[i] is None else max(own[i], x)
    out = {}
    for s, items in table.items():
        columns = [sorted(v[i] for v in items.values() if v[i] is not None) for i in range(4)]
        key = {
            c: sorted(0.0 if v[i] is None else (1 + columns[i].index(v[i])) / len(columns[i]) for i in range(4) if columns[i])
            for c, v in items.items()
        }
        out[s] = sorted(items, key=lambda c: ([-x for x in key[c]], c))
    return out


def ranked(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    v = R.leximin_vectors(df, **k)
    first = {r["search_id"]: r["chunk_id"] for r in dicts(R.leximin_first(v))}
    order = {}
    for r in sorted(dicts(R.leximin_ranking(v)), key=lambda r: r["place"]):
        order.setdefault(r["search_id"], []).append(r["chunk_id"])
    assert first == {s: o[0] for s, o in order.items()}
    return order


@pytest.mark.parametrize("hot_rows", [10**6, 10])
def test_agrees_with_plain_sorting(spark, hot_rows):
    rng = random.Random(1)
    rows = []
    for s in range(6):
        for c in range(rng.randint(1, 40)):
            row = [rng.choice([None, NAN, rng.randint(0, 5) * 10.0**k]) if rng.random() < 0.5 else rng.random() for k in range(4)]
            rows += [(s, f"c{c}", *row)] * rng.choice([1, 1, 2])
    assert ranked(spark, rows, hot_rows=hot_rows) == brute(rows)


def test_a_large_range_does_not_decide(spark):
    rows = [(1, "wide", 1e9, 0.1, 0.1, 0.1), (1, "even", 5.0, 0.5, 0.5, 0.5), (1, "low", 1.0, 0.4, 0.4, 0.4)]
    assert ranked(spark, rows)[1][0] == "even"


def test_missing_scores_never_speak_for_a_row(spark):
    rows = [(1, "a", 1.0, None, None, 0.9), (1, "b", 2.0, None, None, NAN), (2, "x", None, None, None, None)]
    assert ranked(spark, rows) == {1: ["a", "b"], 2: ["x"]}, "a score that a whole search lacks takes no part"


def test_nulls_and_empty(spark):
    assert ranked(spark, []) == {}
    assert ranked(spark, [(None, "a", 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0, 1.0)]) == {}
