"""Two-level ranking against plain windows, with one key holding most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    rows = spark.range(3000).withColumn("key", F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 30).cast("string")))
    return rows.withColumn("v", F.pmod(F.xxhash64("id"), F.lit(1000))).cache()


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_row_number(skewed):
    got = R.bucketed_row_number(skewed, ["key"], ["id"], R.fixed_width_bucket(F.col("id"), 100), "rn", total="n")
    w = Window.partitionBy("key").orderBy("id")
    want = skewed.withColumn("rn", (F.row_number().over(w) - 1).cast("bigint")).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy("key"))
    )
    assert same(got.select("id", "rn", "n"), want.select("id", "rn", "n"))


def test_running(skewed):
    specs = {"s": ("sum", "v", True), "m": ("max", "v", False), "l": ("min", "v", True)}
    got = R.running(skewed, ["key"], ["id"], R.fixed_width_bucket(F.col("id"), 100), specs)
    w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select(
        "id", F.sum("v").over(w).alias("s"), F.max("v").over(before).alias("m"), F.min("v").over(w).alias("l")
    )
    assert same(got.select("id", "s", "m", "l"), want)


def test_previous_value(skewed):
    got = R.previous_value(skewed, ["key"], "id", R.fixed_width_bucket(F.col("id"), 7), "v", "p")
    want = skewed.select("id", F.lag("v").over(Window.partitionBy("key").orderBy("id")).alias("p"))
    assert same(got.select("id", "p"), want)


def test_null_keys_are_reported(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "key string, id bigint")
    ranked = R.bucketed_row_number(df, ["key"], ["id"], F.lit(0), "rn")
    with pytest.raises(Exception, match="must not be NULL"):
        ranked.collect()


def test_sample_is_exact_and_reproducible(skewed):
    wanted = skewed.select("key").distinct().withColumn("want", F.when(F.col("key") == "hot", 777).otherwise(3))
    draw = lambda df: R.sample_per_cell(df, wanted, ["key"], ["id"], [1, F.col("id")], hex_digits=1)
    first = draw(skewed)
    counts = {r["key"]: r["count"] for r in first.groupBy("key").count().collect()}
    assert counts.pop("hot") == 777 and set(counts.values()) == {3}
    assert same(first, draw(skewed.repartition(7)))
    full = skewed.withColumn("h", F.md5(F.concat_ws("|", F.lit("1"), F.col("id").cast("string"))))
    w = Window.partitionBy("key").orderBy("h")
    plain = full.withColumn("r", F.row_number().over(w)).join(wanted, "key").where("r <= want")
    assert same(first.select("id"), plain.select("id"))


def test_short_cell_is_an_error(skewed):
    wanted = skewed.select("key").distinct().withColumn("want", F.lit(500))
    with pytest.raises(Exception, match="not enough rows"):
        R.sample_per_cell(skewed, wanted, ["key"], ["id"], [1, F.col("id")]).collect()


def test_interval_lookup(spark):
    points = spark.range(1000).withColumn("p", F.col("id") / 1000.0)
    bounds = spark.createDataFrame([("a", 0.0, 0.25), ("b", 0.25, 0.2501), ("c", 0.2501, 1.0), ("none", 1.0, 1.0)], "s string, lo double, hi double")
    found = R.lookup_interval(points, "p", bounds, "lo", "hi", 1 / 64)
    counts = {r["s"]: r["count"] for r in found.groupBy("s").count().collect()}
    assert counts == {"a": 250, "b": 1, "c": 749}


def test_salted_join_equals_join(skewed):
    dim = skewed.select("key").distinct().withColumn("d", F.length("key"))
    got = R.salted_join(skewed, dim, ["key"], ["id"], 8)
    assert same(got.select("id", "d"), skewed.join(dim, "key").select("id", "d"))
