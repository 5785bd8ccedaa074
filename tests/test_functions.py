import math

import pytest
from pyspark.sql import functions as F

from sedgework.functions import text as T
from sedgework.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [(" ﻿ a b \t\n", "a b"), ("", ""), ("　", "")])
def test_trimmed_takes_all_unicode_white_space(spark, raw, want):
    assert one(spark, T.trimmed(F.lit(raw))) == want


@pytest.mark.parametrize("text, term, n", [("aaaaa", "aaa", 3), ("École", "ÉCO", 1), ("École", "eco", 0), ("a.b.c.b.", ".b.", 2), ("x", "long", 0), ("", "a", 0)])
def test_occurrences_overlap_and_ignore_case(spark, text, term, n):
    assert one(spark, T.occurrences(F.lit(text), F.lit(term))) == n


def test_occurrences_of_null(spark):
    assert one(spark, T.occurrences(F.lit(None).cast("string"), F.lit("abc"))) == 0


@pytest.mark.parametrize("path, ext, stem", [("/a/B.DOCX", ".docx", "B"), ("/a/.env", "", ".env"), ("/a/x.tar.gz", ".gz", "x.tar"), ("/a/b", "", "b")])
def test_paths(spark, path, ext, stem):
    assert one(spark, T.extension(F.lit(path))) == ext
    assert one(spark, T.stem(F.lit(path))) == stem


@pytest.mark.parametrize(
    "paths, want", [(["/a/b/x", "/a/b/c/y"], "/a/b"), (["/a/b/x"], "/a/b"), (["/a/b/x", "/a/bc/y"], "/a"), (["/a/x", "/b/y"], None)]
)
def test_common_directory(spark, paths, want):
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert df.agg(T.common_directory(F.col("p")).alias("x")).first().x == want


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs)).cast("array<float>")


@pytest.mark.parametrize("a, b, want", [((1, 2), (1, 2), 1), ((1, 0), (0, 1), 0), ((1, 0), (-1, 0), -1), ((1, 2), (10, 20), 1), ((1, 2), (1, 2, 3), 0), ((0, 0), (1, 2), 0)])
def test_cosine(spark, a, b, want):
    assert one(spark, V.cosine(vec(*a), vec(*b))) == pytest.approx(want)


def test_unit_truncation_and_distance(spark):
    assert one(spark, V.unit(vec(0, 0))) == [0, 0]
    assert one(spark, V.norm(V.truncated(vec(3, 4, 12), 2))) == pytest.approx(1)
    assert one(spark, V.l2_to_cosine(V.l2_distance(vec(1, 0), vec(0, 1)))) == pytest.approx(0)


def test_token_estimate_and_hash(spark):
    assert one(spark, T.token_estimate(F.lit("abcde"))) == 2
    assert one(spark, T.sha12(F.lit("a"))) == "ca978112ca1b"
    assert math.isclose(one(spark, T.trigrams(F.lit("abcd"))), 2)
