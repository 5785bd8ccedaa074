"""Plans are the ones wanted: pruned scans, pushed filters, no cross join that grows with the data."""

import os
import re

import pytest

import __spark_entry__ as entry
from sedgework.plans import data_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plan(spark, name):
    """Plan of a query; ``packed`` is what p7 splits, whose own plan begins where it was written."""
    df = (entry.queries() | {"packed": data_queries._packed})[name](spark, DATA)
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def read(text, table):
    return {c.split(":")[0] for part in re.findall(rf"Location: [^\n]*{table}\.parquet[^\n]*\n(?:[^\n]+\n)*?ReadSchema: struct<([^\n]*)>", text) for c in part.split(",")}


@pytest.mark.parametrize(
    "name, table, columns",
    [
        ("p1_reasons", "files", {"path", "hash", "indexed", "embedded"}),
        ("p1_reasons", "scans", {"scan_id", "path", "hash", "seen_at"}),
        ("packed", "files", {"path", "metadata"}),
        ("index_decisions", "scans", {"path", "hash", "seen_at", "scan_id", "size"}),
        ("chunk_identity", "chunks", {"id", "file_path", "chunk_content", "line_start"}),
        ("chunk_markdown", "documents", {"doc_id", "text"}),
    ],
)
def test_scans_read_what_is_needed(spark, name, table, columns):
    assert read(plan(spark, name), table) == columns


@pytest.mark.parametrize("name", ["p1_reasons", "packed", "index_decisions", "upsert", "prune_dropped", "coverage_states", "conversion_states"])
def test_filters_reach_the_scan(spark, name):
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull", plan(spark, name))


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not re.match(r"p\d|hybrid|auto|rerank|context|parent", n)))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_first_pass_combines_before_the_shuffle(spark):
    text = plan(spark, "p1_reasons")
    assert text.count("partial_max") >= 2
