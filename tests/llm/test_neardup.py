import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import dicts
from sedgework.llm import fingerprints as fp
from sedgework.llm import neardup as N

SCHEMA = "kind string, id string, text string, class long"
WORDS = [f"{a}{b}" for a in "ka lo mi nu pe ri so tu va xe".split() for b in "ban der fol gim hus jat kel".split()]


def brute(rows):
    texts = {(k, i, N.normalised(t)) for k, i, t in rows if i is not None and t is not None}
    texts = sorted(x for x in texts if len(x[2]) >= N.LEAST_CHARS)
    sets = [{t[j : j + 5] for j in range(len(t) - 4)} for _, _, t in texts]
    out = set()
    for a, (k, i, _) in enumerate(texts):
        for b in range(a):
            if texts[b][0] == k and texts[b][1] != i and len(sets[a] & sets[b]) >= N.THRESHOLD * len(sets[a] | sets[b]):
                out.add((k, *sorted((i, texts[b][1]))))
    return out


def pairs(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = [(r["kind"], r["id_a"], r["id_b"]) for r in dicts(N.near_pairs(df))]
    assert len(got) == len(set(got))
    return set(got)


def edited(rng, text, n):
    ws = text.split()
    for _ in range(n):
        i = rng.randrange(len(ws))
        rng.choice([lambda: ws.insert(i, rng.choice(WORDS)), lambda: ws.pop(i), lambda: ws.__setitem__(i, rng.choice(WORDS))])()
    return " ".join(ws)


def test_agrees_with_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for g in range(60):
        text = " ".join(rng.choices(WORDS, k=rng.randint(45, 120)))
        for c in range(rng.randint(1, 4)):
            rows.append((rng.choice(["parent", "chunk"]), f"{g}-{c}", edited(rng, text, rng.randint(0, 7))))
    want = brute(rows)
    got = pairs(spark, rows)
    assert got <= want and len(want) > 40
    assert len(got) >= 0.99 * len(want)


def test_an_id_with_several_texts_has_the_pairs_of_each(spark):
    rng = random.Random(3)
    one, two = (" ".join(rng.choices(WORDS, k=90)) for _ in range(2))
    rows = [("parent", "a", one), ("parent", "a", two), ("parent", "b", edited(rng, one, 3)), ("parent", "c", edited(rng, two, 3))]
    want = brute(rows)
    assert want == {("parent", "a", "b"), ("parent", "a", "c")} and pairs(spark, rows) == want


def test_recall_close_to_the_threshold(spark):
    """Pairs between 0.6 and 0.7, which edits rarely give."""
    rng = random.Random(9)
    rows = []
    for g in range(150):
        text = " ".join(rng.choices(WORDS, k=100))
        rows += [("parent", f"{g}-a", text), ("parent", f"{g}-b", edited(rng, text, 22))]
    want = brute(rows)
    assert len(want) > 60 and len(pairs(spark, rows)) >= 0.9 * len(want)


def test_copies_reordering_and_kinds(spark):
    text = " ".join(WORDS)
    halves = text[len(text) // 2 :].strip() + " " + text[: len(text) // 2].strip()
    rows = [("parent", "a", text), ("parent", "b", "  " + text.upper().replace(" ", "\n ")), ("parent", "c", halves), ("chunk", "d", text), ("chunk", "e", text)]
    assert pairs(spark, rows) == {("parent", "a", "b"), ("parent", "a", "c"), ("parent", "b", "c"), ("chunk", "d", "e")}


def test_nulls_short_repeated_and_empty(spark):
    text = " ".join(WORDS)
    rows = [("parent", "a", text), ("parent", "a", text), ("parent", None, text), ("parent", "n", None), ("parent", "s", text[:239]), ("parent", "t", text[:239]), ("parent", "e", "")]
    assert pairs(spark, rows) == set() and pairs(spark, []) == set()
    assert pairs(spark, [("parent", "x", "a" * 300), ("parent", "y", "a" * 50_000)]) == {("parent", "x", "y")}, "one substring each"


def test_groups(spark):
    rng = random.Random(2)
    text = " ".join(rng.choices(WORDS, k=200))
    chain = [text]
    for _ in range(5):
        chain.append(edited(rng, chain[-1], 14))
    rows = [("parent", f"c{i}", t) for i, t in enumerate(chain)] + [("parent", "copy", chain[0]), ("parent", "alone", " ".join(str(rng.random()) for _ in range(40)))]
    got = {r["id"]: r for r in dicts(N.near_groups(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)))}
    assert len({got[f"c{i}"]["root"] for i in range(6)}) == 1 and got["alone"]["root"] != got["c0"]["root"] and got["alone"]["links"] == 0
    assert got["copy"]["class"] == got["c0"]["class"] and got["c1"]["links"] >= 2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in dicts(N.components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {x: find(x) for x in root}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_bitmap_never_loses_a_value(spark):
    df = spark.createDataFrame([(f"id{i}",) for i in range(500)], "id string")
    some = df.where("cast(substring(id, 3) as int) % 7 = 0")
    kept = {r["id"] for r in dicts(N.where_may_contain(df, "id", some))}
    assert {r["id"] for r in dicts(some)} <= kept and len(kept) < 100


def test_plan_has_no_cross_join(spark):
    df = spark.createDataFrame([("parent", "a", " ".join(WORDS), 1)], SCHEMA)
    plan = N.candidates(N.fingerprinted(df))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def varied(rng, base, n):
    """Different texts around one base, each with its own words."""
    out = []
    for i in range(n):
        words = base.split()
        for k in rng.sample(range(len(words)), 4):
            words[k] = f"w{i}x{k}"
        out.append(" ".join(words))
    return out


def test_hot_keys_are_joined_in_parts_with_the_same_result(spark):
    rng = random.Random(5)
    base = " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(90))
    rows = [("parent", f"p{i:03d}", t) for i, t in enumerate(varied(rng, base, 60))]
    prints = N.fingerprinted(spark.createDataFrame(rows, "kind string, id string, text string"))
    keyed = N._keyed(prints)
    assert N._hot_cells(keyed, N.HOT_RECORDS) is None
    cells = {r["cell"]: r["parts"] for r in N._hot_cells(keyed, 8).collect()}
    assert cells and max(cells.values()) > 1
    whole = {tuple(r) for r in N.candidates(prints).collect()}
    assert {tuple(r) for r in N.candidates(prints, hot=8).collect()} == whole and len(whole) > 1000


def test_distance_counts_bits(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 31, (40, N.BINS * N.FUNCTIONS)).astype(np.uint32)
    b = np.where(rng.random(a.shape) < 0.4, rng.integers(0, 1 << 31, a.shape).astype(np.uint32), a)
    rows = [(*map(int, x), *map(int, y)) for x, y in zip(fp.pack_bits(a), fp.pack_bits(b))]
    names = [f"{side}{s}" for side in "ab" for s in N.SKETCH]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names))
    df = df.select(*(F.struct(*(F.col(f"{side}{s}").alias(s) for s in N.SKETCH)).alias(side) for side in "ab"))
    got = [r[0] for r in df.select(N.distance("a", "b")).collect()]
    assert got == ((a & 1) != (b & 1)).sum(axis=1).tolist()


def test_values_too_many_for_a_bitmap_are_joined(spark, monkeypatch):
    df = spark.createDataFrame([(f"v{i}", i) for i in range(200)], "v string, n int")
    few = spark.createDataFrame([("v3",), ("v7",), ("v7",)], "v string")
    met = {r["v"] for r in N.where_may_contain(df, "v", few).collect()}
    assert {"v3", "v7"} <= met and len(met) < 100
    monkeypatch.setattr(N, "MOST_FILTER_BITS", 1)
    assert sorted(r["v"] for r in N.where_may_contain(df, "v", few).collect()) == ["v3", "v7"]
