"""Exact top-k against all products."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.inner_products import needed_length, open_pairs, top_inner_products


def brute(rows, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % 5 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in whole if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("slice_rows, query_block", [(40, 3), (10**6, 512)])
def test_top_k(spark, slice_rows, query_block):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(24)]) for i in range(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)]  # a very common vector
    rows += [(2000, None), (2001, [None] * 24), (2005, [math.nan] * 24), (2010, [math.inf] + [0.0] * 23), (None, rows[0][1]), (2015, [0.0] * 24), (2020, [1.0, 2.0]), (2025, [])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, norm double")
    got = top_inner_products(df, F.col("vec_id") % 5 == 0, slice_rows=slice_rows, query_block=query_block)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0]), (7, [0.5, 0.5]), (8, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_inner_products(df, F.col("vec_id") == 5).orderBy("rank").collect()]
    assert got == [(5, 1, 7, 1024 * 512), (5, 2, 8, 1024 * 512)]
    assert top_inner_products(df, F.lit(False)).collect() == []
    assert top_inner_products(df.limit(0), F.lit(True)).collect() == []


def test_scores_that_leave_64_bits_are_an_error(spark):
    far = spark.createDataFrame([(0, [3e6] * 4), (1, [3e6] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too long for scores"):
        top_inner_products(far, F.col("vec_id") == 0).collect()


def test_slices_of_short_vectors_meet_no_query(spark, monkeypatch):
    from tessera.llm import inner_products

    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * 0.97**i for _ in range(12)]) for i in range(400)] + [(400, [0.0] * 12), (405, [-1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    met = []

    def counted(asks, reach, first, end):
        pairs = open_pairs(asks, reach, first, end)
        met.append((pairs.count(), asks.select("block").distinct().count() * (end - first)))
        return pairs

    monkeypatch.setattr(inner_products, "open_pairs", counted)
    got = top_inner_products(df, F.col("vec_id") % 5 == 0, k=5, slice_rows=25, query_block=4)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute(rows, 5)
    later = met[1:]
    assert later and sum(n for n, _ in later) < sum(of for _, of in later) / 2


def test_needed_length(spark):
    rows = [(10, 2.0, 5.0), (None, 2.0, -1.0), (0, 0.0, -1.0), (-4, 2.0, -2.0), (10**18, 2.0**30, 10**18 / 2.0**30)]
    df = spark.createDataFrame(rows, "least long, norm double, want double")
    for r in df.withColumn("got", needed_length(F.col("least"), F.col("norm"))).collect():
        assert r["got"] == pytest.approx(r["want"], rel=1e-6) and (r["want"] < 0 or r["got"] <= r["want"])
