"""Queries and SQL of the core's training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgework.operators.incremental import next_batch, pending_paths
from sedgework.operators.multivalue import split_values
from sedgework.session import checkpoint_dir, table


def _states(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("files", "scans", "index_runs")]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_batch(*_states(spark, sf_dir), f"{checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_paths(*_states(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("paths"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").where("path is not null")
    return files.groupBy("path").agg(F.max("metadata").alias("metadata"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_values(_packed(spark, sf_dir), "path", "metadata")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir)


def p7_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).groupBy("value").agg(F.count("*").alias("uses"), F.min("pos").alias("first_pos"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p7_found": p7_found, "p7_tag_counts": p7_tag_counts}

_P1 = """
with runs as (
  select status, started_at, coalesce(finished_at, lead(started_at) over (order by started_at)) as ends,
         finished_at is null as open from index_runs),
rows_ as (select path, cast(indexed as timestamptz) as written, lower(left(hash, 12)) as h, embedded from files),
good as (
  select * from rows_ r where not exists (
    select 1 from runs where status is distinct from 'ok' and r.written >= started_at
      and (ends is null or r.written < ends or (not open and r.written = ends)))),
state as (select path, h, embedded from good
  qualify row_number() over (partition by path order by written desc, coalesce(embedded, false) desc, h desc nulls last) = 1),
seen as (select path, lower(left(hash, 12)) as h from scans where hash is not null
  qualify row_number() over (partition by path order by seen_at desc, scan_id desc) = 1),
cases as (
  select seen.path, case when state.path is null then 'new' when seen.h is distinct from state.h then 'changed'
    when state.embedded is not true then 'not embedded' end as reason
  from seen left join state on seen.path = state.path)
"""

# apostrophes between letters are set aside, so that every other single quote encloses
_P7 = r"""
with packed as (
  select path, regexp_replace(max(metadata), '([A-Za-z])''([a-z])', '\1' || chr(2) || '\2', 'g') as m from files where path is not null group by path),
cut as (
  select path, string_split(regexp_replace(m,
    '("(?:[^"]|"")*"|''(?:[^'']|'''')*''|“[^”]*”|„[^“]*“|‘[^’]*’|「[^」]*」|『[^』]*』|«[^»]*»)|[,;|\t\n\r、，；]|(?:^|\s)/(?:\s|$)',
    '\1' || chr(31), 'g'), chr(31)) as parts from packed where m is not null),
trimmed as (
  select path, list_filter(list_transform(parts, lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))), lambda p: p <> '') as vs from cut),
bare as (
  select path, list_filter(list_transform(vs, lambda p: replace(trim(
    case when length(p) > 1 and p[1] = '"' and p[-1] = '"' then replace(p[2:-2], '""', '"')
      when length(p) > 1 and p[1] = chr(39) and p[-1] = chr(39) then replace(p[2:-2], chr(39) || chr(39), chr(39))
      when length(p) > 1 and p[1] in ('“', '„', '‘', '「', '『', '«') and p[-1] in ('”', '“', '’', '」', '』', '»') then p[2:-2] else p end),
    chr(2), chr(39))), lambda p: p <> '') as vs from trimmed),
tags as (select path, cast(unnest(range(1, len(vs) + 1)) as int) as pos, unnest(vs) as value from bare)
"""

SQL = {
    "p7_found": _P7 + "select path, pos, value from tags",
    "p7_tag_counts": _P7 + "select value, count(*) as uses, min(pos) as first_pos from tags group by value",
    "p1_found": _P1 + "select path from cases where reason is not null",
    "p1_reasons": _P1 + "select reason, count(*) as paths from cases where reason is not null group by reason",
}
