import random

import pytest

from conftest import dicts
from sedgework.llm import mixing as M

SIZED, TARGETS = "doc_id long, source string, tokens int", "source string, target_share double, max_repeats int"


def plain_apportion(weights, seats, most):
    won = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [n for n in weights if weights[n] > 0 and won[n] < most.get(n, seats)]
        if not open_:
            break
        best = max(open_, key=lambda n: (weights[n] / (2 * won[n] + 1), [-ord(c) for c in n]))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(20))
def test_apportionment_agrees_with_seat_by_seat(seed):
    rng = random.Random(seed)
    weights = {c: rng.random() * rng.choice([1, 10]) for c in "abcdef"[: rng.randint(1, 6)]}
    seats = rng.randint(0, 300)
    most = {c: rng.randint(0, 80) for c in weights if rng.random() < 0.4}
    assert M.apportion(weights, seats, most) == plain_apportion(weights, seats, most)


def mixed(spark, docs, targets, **k):
    sized = spark.createDataFrame(docs, SIZED)
    plan = M.quotas(sized, spark.createDataFrame(targets, TARGETS), **k)
    return {r["source"]: r for r in dicts(plan)}, dicts(M.mixture(sized, plan)), {r["source"]: r["share"] for r in dicts(M.shares(M.mixture(sized, plan)))}


def test_shares_follow_targets_within_repeats(spark):
    docs = [(i, "big" if i % 3 else "small", 10 + i % 5) for i in range(3000)]
    plan, rows, shares = mixed(spark, docs, [("big", 0.4, 1), ("small", 0.6, 2)])
    assert not plan["big"]["short"] and not plan["small"]["short"]
    assert shares["big"] == pytest.approx(0.4, abs=0.01) and shares["small"] == pytest.approx(0.6, abs=0.01)
    assert max(r["times"] for r in rows) <= 2 and len({r["doc_id"] for r in rows}) == len(rows)


def test_short_sources_give_what_they_have(spark):
    docs = [(i, "a" if i < 10 else "b", 100) for i in range(110)]
    plan, rows, shares = mixed(spark, docs, [("a", 0.5, 2), ("b", 0.5, 3), ("none", 0.1, 1)])
    assert plan["a"]["short"] and plan["none"]["short"] and not plan["b"]["short"]
    assert {r["times"] for r in rows if r["source"] == "a"} == {2}
    assert sum(r["tokens"] * r["times"] for r in rows) == pytest.approx(plan["a"]["total"], rel=0.05), "others fill the total"


def test_small_sources_meet_their_quota_beside_many_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "DOCUMENTS_PER_SHARD", 100)
    docs = [(i, "small" if i < 20 else "big", 100 + i % 7) for i in range(4000)]
    sized = spark.createDataFrame(docs, SIZED)
    for share in (0.002, 0.003, 0.004):
        plan = M.quotas(sized, spark.createDataFrame([("big", 1 - share, 1), ("small", share, 1)], TARGETS), 4000)
        quota = {r["source"]: r["quota"] for r in dicts(plan)}
        used = {r["source"]: r["used_tokens"] for r in dicts(M.shares(M.mixture(sized, plan)))}
        assert abs(used["small"] - quota["small"]) <= 54, "half a document"
        assert abs(used["big"] - quota["big"]) <= 54 * 40, "half a document a shard"


def test_shards_get_whole_blocks_that_sum_to_those_of_the_source(spark):
    placed = spark.createDataFrame([("s", i % 7, 5, 10 + i) for i in range(70)], "source string, _shard int, shards int, tokens int")
    own = {k: sum(10 + i for i in range(70) if i % 7 == k) for k in range(7)}
    for rest, blocks in ((1001, 20), (3115, 62), (0, 0)):
        parts = M._shard_blocks({"s": rest, "t": 130}, {"s": 7, "t": 1}, 50, placed)
        assert ("t", 0, 3) in parts and sum(n for s, _, n in parts if s == "s") == blocks and len(parts) == 8
        assert all(n * 50 < own[k] + 50 for s, k, n in parts if s == "s")


def test_seeded_and_odd_input(spark):
    docs = [(1, "a", 0), (2, None, 5), (3, "a", 5), (3, "a", 5), (4, "other", 5)]
    plan, rows, _ = mixed(spark, docs, [("a", 1.0, 1), (None, 0.3, 1), ("a", 1.0, 1)])
    assert list(plan) == ["a"] and all(r["source"] == "a" and r["tokens"] for r in rows)
    assert mixed(spark, docs, [("a", 1.0, 1)])[1] == mixed(spark, docs, [("a", 1.0, 1)])[1]
    assert mixed(spark, [], [("a", 1.0, 1)])[1] == [] and mixed(spark, docs, [])[0] == {}
