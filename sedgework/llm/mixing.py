"""Mixing sources to target weights.

Sizes per source are one aggregation. The seats of a Sainte-Lague apportionment are
equal-token blocks; a source stops winning seats at its capacity, which is its size
times its permitted repeats. What a source's quota leaves beyond whole uses is then
apportioned to its shards in whole blocks, and the seeded order inside (source, shard)
decides which blocks those are. Shards are salts: a source has as many as its own
documents need, so no window holds a large source as a whole and a small one is not
cut into pieces of single documents.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 20_000
DOCUMENTS_PER_SHARD = 200_000


def apportion(weights: dict[str, float], seats: int, most: dict[str, int] | None = None) -> dict[str, int]:
    """Sainte-Lague: seats by highest quotients ``weight / (2 won + 1)``; ties to the lesser name.

    ``most`` limits what a name may win; seats that nobody can win stay empty. The
    bulk is given at once by rounding to a common divisor from below, the rest by
    the heap, so the work does not grow with the number of seats.
    """
    most = most or {}
    names = sorted(n for n, w in weights.items() if w > 0)
    won = dict.fromkeys(weights, 0)
    room = {n: most.get(n, seats) for n in names}
    total = sum(weights[n] for n in names)
    for n in names:  # a lower bound on what each wins: nobody else can lower its share
        won[n] = min(room[n], max(0, math.floor(weights[n] / total * seats) - len(names)))
    heap = [(-weights[n] / (2 * won[n] + 1), n) for n in names if won[n] < room[n]]
    heapq.heapify(heap)
    for _ in range(seats - sum(won.values())):
        if not heap:
            break
        _, n = heapq.heappop(heap)
        won[n] += 1
        if won[n] < room[n]:
            heapq.heappush(heap, (-weights[n] / (2 * won[n] + 1), n))
    return won


def source_sizes(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, tokens, documents`` of each target; sources without rows have 0.

    ``targets`` is configuration, a row per source. Repeated target rows count once
    (the greatest share and repeats); a null source is no target.
    """
    own = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    wanted = targets.where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    return wanted.join(own, "source", "left").select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
    )


def quotas(sized: DataFrame, targets: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``source, target_share, max_repeats, tokens, documents, total, short, block, quota, quota_share``.

    ``short``: the target is more than ``max_repeats`` times the source's own size.
    ``quota`` is the source's part in tokens. What short sources cannot give goes to
    the others by the same quotients, so the quotas of all fill the total as far as
    capacities allow. The seats are apportioned on the driver, from one row per
    target. No targets give no rows.
    """
    spark = sized.sparkSession
    rows = source_sizes(sized, targets).collect()  # one row per row of the targets' configuration
    total = sum(r["tokens"] for r in rows)
    block = max(1, math.ceil(total / blocks))
    seats = total // block
    capacity = {r["source"]: r["max_repeats"] * r["tokens"] // block for r in rows}
    won = apportion({r["source"]: r["target_share"] for r in rows}, seats, capacity)
    out = [
        (
            *r,
            total,
            r["target_share"] * total > r["max_repeats"] * r["tokens"],
            block,
            won[r["source"]] * block,
            won[r["source"]] / seats if seats else 0.0,
        )
        for r in rows
    ]
    return spark.createDataFrame(
        out,
        "source string, target_share double, max_repeats int, tokens long, documents long, total long,"
        " short boolean, block long, quota long, quota_share double",
    )


def _shard_blocks(rest: dict[str, int], shards: dict[str, int], block: int, placed: DataFrame) -> list[tuple[str, int, int]]:
    """``source, shard, blocks``: how many blocks each source takes beyond whole uses, by shard; those of a source sum to its own.

    By the same quotients as the sources, with the shards' tokens as weights and
    their blocks as limits. A source of one shard needs no sums.
    """
    wanted = {s: (n + block // 2) // block for s, n in rest.items()}
    out = [(s, 0, wanted[s]) for s in wanted if shards[s] == 1]
    sums: dict[str, dict[int, int]] = {s: {} for s in wanted if shards[s] > 1}
    if sums:
        own = placed.where("shards > 1").groupBy("source", "_shard").agg(F.sum("tokens").alias("n"))
        for r in own.collect():  # a row per DOCUMENTS_PER_SHARD documents
            sums[r["source"]][r["_shard"]] = r["n"]
    for s, own in sums.items():
        out += [(s, i, n) for i, n in apportion(own, wanted[s], {i: math.ceil(n / block) for i, n in own.items()}).items()]
    return out


def mixture(sized: DataFrame, plan: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``key, source, tokens, times``: how often each document is used, never more than ``max_repeats``.

    ``sized`` has ``key, source, tokens``; ``plan`` comes from :func:`quotas`. Each
    (source, shard) is put into a seeded order and that is cut into blocks of equal
    tokens; a document belongs to the block that holds its middle. A document is used
    ``quota // size`` times, those of the first blocks once more: as many blocks as
    the shard has been given, a whole number. A source is met up to half a block and
    half a document for each of its shards. Documents used no time, empty ones and
    sources without a target are left out. Repeated rows are documents of their own.
    """
    rows = [r for r in plan.collect() if r["tokens"]]  # one row per target
    block = rows[0]["block"] if rows else 1
    shards = {r["source"]: max(1, math.ceil(r["documents"] / DOCUMENTS_PER_SHARD)) for r in rows}
    parts = [(r["source"], min(r["quota"] // r["tokens"], r["max_repeats"]), r["max_repeats"], shards[r["source"]]) for r in rows]
    plan = sized.sparkSession.createDataFrame(parts, "source string, base int, most int, shards int")
    placed = (
        sized.where("tokens > 0")
        .join(F.broadcast(plan), "source")  # as many rows as mix_targets, a configuration
        .withColumn("_at", F.xxhash64(F.lit(seed), F.col(key)))
        .withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.col("shards")).cast("int"))
    )
    given = _shard_blocks({r["source"]: r["quota"] % r["tokens"] for r in rows}, shards, block, placed)
    given = sized.sparkSession.createDataFrame(given, "source string, _shard int, _given long")
    group = Window.partitionBy("source", "_shard")
    before = F.sum("tokens").over(group.orderBy("_at", key).rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.join(F.broadcast(given), ["source", "_shard"])  # a row per DOCUMENTS_PER_SHARD documents
    number = F.floor((F.coalesce(before, F.lit(0)) + F.col("tokens") / 2) / block)
    once_more = (number < F.col("_given")) & (F.col("base") < F.col("most"))
    times = F.col("base") + F.when(once_more, 1).otherwise(0)
    return placed.withColumn("times", times.cast("int")).where("times > 0").select(key, "source", "tokens", "times")


def shares(mixed: DataFrame) -> DataFrame:
    """``source, used_documents, used_tokens, share``: what a mixture really holds."""
    own = mixed.groupBy("source").agg(
        F.count("*").alias("used_documents"), F.sum(F.col("tokens") * F.col("times")).alias("used_tokens")
    )
    everything = F.sum("used_tokens").over(Window.partitionBy())  # over one row per source
    return own.select("*", (F.col("used_tokens") / everything).alias("share"))
