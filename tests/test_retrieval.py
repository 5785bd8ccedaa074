import random
import sqlite3

import pytest

from conftest import dicts
from sedgework.operators import fusion, lexical, vector

DOCS = "id string, content string, path string, metadata string"


def docs(spark, *rows):
    return spark.createDataFrame([(f"c{i}", *(r if isinstance(r, tuple) else (r, "/f.md", None))) for i, r in enumerate(rows)], DOCS)


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, query_text string")


def hits(spark, d, q, **k):
    return [r["id"] for r in dicts(fusion.hybrid_search(d, queries(spark, q), **k).orderBy("place"))]


def test_bm25_agrees_with_full_text_search(spark):
    """Score and rows of an embedded full-text index with the same tokenizer and weights."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(a, b, c, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer here")
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "aaaa", "ab", "École", "倉庫管理", "x.y-z", 'q"uote', "Delta"]
    rows = [tuple(" ".join(rng.choices(words, k=rng.randint(0, 6))) if rng.random() > 0.2 else None for _ in range(3)) for _ in range(60)]
    for i, r in enumerate(rows):
        con.execute("insert into t(rowid, a, b, c) values (?, ?, ?, ?)", (i, *r))
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, content string, path string, metadata string")
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(40)] + ["", "  ", "ab", "ab alpha"]
    got = {}
    for r in dicts(lexical.bm25(d, list(enumerate(texts)), 1000)):
        got.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    for q, text in enumerate(texts):
        match = " ".join('"' + t.replace('"', '""') + '"' for t in text.split())
        want = dict(con.execute("select rowid, bm25(t, 1.0, 0.5, 1.5) from t where t match ?", (match,))) if match else {}
        assert got.get(q, {}).keys() == want.keys(), text
        for i, s in want.items():
            assert got[q][i] == pytest.approx(s, abs=1e-9)


def test_blocks_of_queries_give_the_rows_of_one(spark, monkeypatch):
    d = docs(spark, ("alpha beta", "/a.md", "gamma"), ("alpha alpha gamma", "/b.md", None), ("nothing", "/gamma.md", "beta"))
    asked = [(0, "alpha"), (1, "gamma"), (2, "beta alpha"), (3, "gamma")]
    rows = lambda: sorted(map(tuple, lexical.bm25(d, asked, 9).collect()))
    whole = rows()
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 8)
    assert len(list(lexical._blocks(asked))) > 1 and rows() == whole != []


def test_sections_with_only_void_or_unclosed_tags_are_converted(spark, tmp_path):
    from sedgework.plans import retrieval_queries

    rows = [("a", "one<br>two"), ("b", '<img src="x.png" alt="y">'), ("c", "<ul><li>one<li>two"), ("d", "<b>z</b>"), ("e", "1 < 2 and 3 > 2")]
    spark.createDataFrame(rows, "id string, content string").write.parquet(str(tmp_path / "parents.parquet"))
    got = {r["id"]: r["markdown"] for r in dicts(retrieval_queries.html_to_markdown(spark, str(tmp_path)))}
    assert got.keys() == {"a", "b", "c", "d"} and "- one" in got["c"] and got["d"] == "**z**"


def test_terms_are_anded_substrings_over_columns(spark):
    d = docs(spark, ("the user logs", "/a.md", None), ("nothing", "/users.md", "logs"), ("user only", "/b.md", None))
    assert set(hits(spark, d, "user logs")) <= {"c0", "c1"}
    assert [r["id"] for r in dicts(lexical.bm25(d, [(0, "user logs")], 9))] and hits(spark, d, "xy") == []


def test_worst_hit_is_dropped_and_equal_scores_are_one(spark):
    d = docs(spark, "alpha alpha alpha", "alpha and much else that makes the text longer")
    assert hits(spark, d, "alpha") == ["c0"]
    same = docs(spark, "alpha beta", "alpha beta")
    assert hits(spark, same, "alpha") == ["c0", "c1"]


def test_path_and_tag_boosts(spark):
    d = docs(spark, ("auth here twice auth", "/x.md", None), ("auth once", "/auth.md", None), ("auth in a rather long text of many words", "/y.md", "auth"))
    rows = {r["id"]: r for r in dicts(fusion.hybrid_search(d, queries(spark, "auth")))}
    assert rows["c2"]["hybrid"] == pytest.approx(min(1, rows["c2"]["bm25"] + 0.2))


def test_blend_and_missing_sides(spark):
    d = docs(spark, "alpha one", "alpha alpha two", "other")
    vs = spark.createDataFrame([("c0", [1.0, 0.0]), ("c2", [0.0, 1.0]), ("orphan", [-1.0, 0.0])], "id string, embedding array<float>")
    qv = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    rows = {r["id"]: r for r in dicts(fusion.hybrid_search(d, queries(spark, "alpha"), vs, qv, alpha=0.5))}
    assert "orphan" not in rows and rows["c2"]["vector"] == pytest.approx(0.5), "orphans count for the range"
    for r in rows.values():
        assert r["hybrid"] == pytest.approx(0.5 * r["bm25"] + 0.5 * r["vector"])


def test_rerank_clamps_and_caps(spark):
    d = docs(spark, *[f"alpha text {'x' * i}" for i in range(40)])
    rows = dicts(fusion.hybrid_search(d, queries(spark, "alpha"), limit=30, scorer=lambda q, ps: [-2.0] + [9.0] * (len(ps) - 1)).orderBy("place"))
    assert len(rows) == 20 and rows[0]["rerank"] == 1.0 and rows[-1]["rerank"] == 0.0
    assert fusion.clamp("x") == fusion.clamp(float("nan")) == 0.0


def test_parents_and_threshold(spark):
    d = spark.createDataFrame([("c0", "alpha", "/a", None, "p0"), ("c1", "alpha", "/a", None, None)], DOCS + ", parent_id string")
    p = spark.createDataFrame([("p0", "whole section", "H")], "id string, content string, heading string")
    rows = {r["id"]: r for r in dicts(fusion.hybrid_search(d, queries(spark, "alpha"), parents=p))}
    assert rows["c0"]["parent_content"] == "whole section" and rows["c1"]["parent_content"] is None
    assert hits(spark, d, "alpha", threshold=2.0) == []


def test_normalize_of_equal_scores_is_zero(spark):
    df = spark.createDataFrame([(0, 3.0), (0, 3.0), (1, 0.0), (1, 10.0)], "q int, s double")
    assert [r["normalized"] for r in dicts(fusion.normalize(df, "s", ["q"]).orderBy("q", "s"))] == [0, 0, 0, 1]


def test_nearest_agrees_with_brute_force(spark):
    rng = random.Random(2)
    vs = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(90)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(vs, "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [0.5, 0.5, 0.5])], "query_id long, embedding array<float>")
    got = dicts(vector.nearest(df, asked, 7).orderBy("query_id", "vec_rank"))
    for q, v in ((1, [0.0, 0.0, 1.0]), (2, [0.5, 0.5, 0.5])):
        want = sorted((sum((a - b) ** 2 for a, b in zip(v, w)) ** 0.5, i) for i, w in vs[:90])[:7]
        assert [r["id"] for r in got if r["query_id"] == q] == [i for _, i in want]


def test_empty_tables(spark):
    d = spark.createDataFrame([], DOCS)
    assert hits(spark, d, "alpha") == []
    none = spark.createDataFrame([], "query_id long, query_text string")
    assert fusion.hybrid_search(docs(spark, "alpha"), none).count() == 0


def test_plans_keep_texts_out_of_shuffles(spark):
    d = docs(spark, "alpha")
    plan = lexical.bm25(d, [(0, "alpha")], 5)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]  # what is made of the rows of the tasks
    assert "Exchange" in above and "content" not in above and "CartesianProduct" not in plan


def test_a_task_keeps_its_best_rows_only(spark):
    d = docs(spark, *(f"alpha {'beta ' * (i % 7)}" for i in range(300))).coalesce(1)
    kept = lexical.bm25(d, [(0, "alpha beta"), (1, "alpha")], 3)
    assert [(r["query_id"], r["bm25_rank"]) for r in sorted(dicts(kept), key=lambda r: (r["query_id"], r["bm25_rank"]))] == [(q, k) for q in (0, 1) for k in (1, 2, 3)]
    every = lexical.bm25(d, [(0, "alpha beta"), (1, "alpha")], 1000)
    want = {(r["query_id"], r["bm25_rank"]): (r["id"], round(r["score"], 9)) for r in dicts(every)}
    assert all(want[r["query_id"], r["bm25_rank"]] == (r["id"], round(r["score"], 9)) for r in dicts(kept))


def test_vectors_without_names_and_docs_without_ids_are_not_found(spark):
    vs = spark.createDataFrame([(None, [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["id"] for r in sorted(dicts(vector.nearest(vs, asked, 2)), key=lambda r: r["vec_rank"])] == ["a", "b"]
