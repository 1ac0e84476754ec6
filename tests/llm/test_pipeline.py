"""The pipeline's stages against what they promise."""

import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from tessera import session
from tessera.llm import quality
from tests.llm.test_near_dedup import brute


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "exact dedup", "near dedup", "best-fit packing"]
    good = steps["quality classifier"](spark, docs, sf)
    kept = {r["doc_id"] for r in quality.score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert set(rows(good)) == kept and good.columns == docs.columns

    exact = steps["exact dedup"](spark, docs, sf)
    best = {}
    for r in docs.collect():
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r["text"]).encode()).hexdigest()
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert set(rows(exact)) == {i for _, i in best.values()} and exact.columns == docs.columns

    near = steps["near dedup"](spark, docs, sf)
    assert set(rows(near)) == {r[0] for r in brute([(r["doc_id"], r["text"]) for r in docs.collect()], percent=80) if r[3]}
    assert rows(near) == {i: r for i, r in rows(docs).items() if i in rows(near)}

    packed = steps["best-fit packing"](spark, near, sf)
    assert {r["doc_id"] for r in packed.collect()} == set(rows(near))


def test_empty_and_odd_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**7, "", "en", "s", 0), (10**7, "", "en", "s", 0), (10**7 + 1, "x " * 30000, "en", "s", 60000)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == [], name
        stage(spark, docs.limit(20).union(odd), sf).collect()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 50


def test_near_copies_from_four_fifths(spark, sf):
    """The stage against all pairs at 0.80, and what follows it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    near = steps["near dedup"](spark, docs, sf)
    assert set(rows(near)) == {r[0] for r in brute([(r["doc_id"], r["text"]) for r in docs.collect()], percent=80) if r[3]}
    assert rows(near) == {i: r for i, r in rows(docs).items() if i in rows(near)}
    assert {r["doc_id"] for r in steps["best-fit packing"](spark, near, sf).collect()} == set(rows(near))


def test_rows_stay_one_by_one(spark, sf):
    """NULL and repeated ids with different texts: a stage drops the copies and nothing else."""
    long = " ".join(f"w{k}" for k in range(60))
    near = long.replace("w30", "other")
    given = [
        (None, ""), (1, None), (None, "unique without id"), (None, "another without id"), (2, "said twice"), (2, "said twice"), (2, "its own text"), (3, "saidtwice "),
        (None, long), (None, near), (4, "alone"), (5, long + " end"), (6, "x y z q"), (6, "x y z q"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(given)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    steps = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)
    exact = steps["exact dedup"](spark, docs, sf)
    assert exact.columns == docs.columns
    kept = [(1, None), (None, "unique without id"), (None, "another without id"), (2, "its own text"), (2, "said twice"), (None, long), (None, near), (4, "alone"), (5, long + " end"), (6, "x y z q")]
    assert texts(exact) == sorted(kept, key=str)
    kept = [x for x in kept if x not in ((None, long), (None, near))]
    assert texts(steps["near dedup"](spark, exact, sf)) == sorted(kept, key=str)
    # Without any id one row of a component stays, and so with one id.
    copies = docs.where(F.col("text").isin(long, near)).withColumn("doc_id", F.lit(None).cast("long"))
    for ids in (copies, copies.withColumn("doc_id", F.lit(9).cast("long"))):
        assert steps["near dedup"](spark, ids, sf).count() == 1


def test_columns_with_the_names_used_inside(spark, sf, tmp_path):
    """All columns come through the filtering stages, whatever their names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).selectExpr("*", "doc_id AS __row", "n_chars AS row", "lang AS keep_row", "source AS _metadata", "1 AS node")
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    for given in (docs, stored):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, given, sf)
            assert kept.columns == docs.columns, name
            assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in stored.collect()}, name


def test_scratch_of_a_stage_goes(spark, sf, tmp_path, monkeypatch):
    """What a stage leaves in the shared folder is the list of dropped rows, no copies of texts."""
    monkeypatch.setattr(session, "_LOCAL_SCRATCH", [str(tmp_path)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        kept = stage(spark, docs, sf)
        assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"dropped"}, name
        assert kept.count() > 50
