"""Plans of the operators for training text."""

import os
import re

import pytest

from sedgework.llm import neardup, queries
from sedgework.session import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def explain(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize(
    "name, schema",
    [
        ("p4_found", ["struct<id:string,content:string>", "struct<id:string,chunk_content:string>"]),
        ("p5_found", ["struct<search_id:bigint,chunk_id:string,bm25:double,vector:double,hybrid:double,rerank:double>"]),
        ("p6_found", ["struct<id:string,content:string,heading:string>"]),
        ("p8_ids", ["struct<doc_id:bigint,text:string>"]),
    ],
)
def test_scans_read_what_is_needed(spark, name, schema):
    assert set(re.findall(r"ReadSchema: (struct<.*>)", explain(queries.QUERIES[name](spark, DATA)))) == set(schema)


def test_both_sides_of_the_key_join_are_one_exchange(spark):
    prints = neardup.fingerprinted(queries._records(spark, DATA))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = neardup.candidates(prints)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in text and "SortMergeJoin" in text


def test_texts_do_not_leave_the_task_that_tokenizes_them(spark):
    text = explain(queries.tokenizing.token_ids(table(spark, DATA, "documents"), "doc_id", "text"))
    assert "Exchange" not in text
