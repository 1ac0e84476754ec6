"""Leak-free train/test splits with a controlled label-centre correlation.

All repetitions and correlation levels are columns of one plan; nothing loops
over splits on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hex_to_long
from tessera.operators.agreement import cramers_v
from tessera.operators.allocations import (
    TABULATED,
    TABULATED_DATASETS,
    custom_allocation,
    tabulated_allocation,
)
from tessera.operators.ranking import salted_join, sample_per_cell
from tessera.schemas import SPLIT_ROW
from tessera.session import materialize

CELL = ["label", "medical_center"]


def _numbers(low: int, high: int):
    return F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint")))


def test_slides(id_rows: DataFrame, fraction: float, seed: int, repetitions: int) -> DataFrame:
    """Slides held out per (rep, label, centre).

    ``n = max(1, round(S * fraction))`` of S slides, at most S - 1, none of one.
    """
    slides = (
        id_rows.select(*CELL, "slide_id").distinct().withColumn("rep", _numbers(0, repetitions - 1))
    )
    cell = ["rep", *CELL]
    s = F.col("s")
    wanted = slides.groupBy(*cell).agg(F.count(F.lit(1)).alias("s")).withColumn(
        "want",
        F.when(s <= 1, F.lit(0)).otherwise(
            F.least(s - 1, F.greatest(F.lit(1), F.bround(s * F.lit(float(fraction)), 0).cast("bigint")))
        ),
    )
    key = [seed, F.col("rep"), F.col("label"), F.col("medical_center"), F.col("slide_id")]
    return sample_per_cell(slides, wanted, cell, ["slide_id"], key)


def slide_level_split(
    id_rows: DataFrame,
    fraction: float,
    seed: int = 0,
    repetitions: int = 1,
    held: DataFrame | None = None,
) -> DataFrame:
    """Every row once per repetition, with ``held_out`` for the test slides."""
    held = held or test_slides(id_rows, fraction, seed, repetitions)
    held = held.withColumn("__held", F.lit(True))
    tagged = id_rows.withColumn("rep", _numbers(0, repetitions - 1))
    return (
        salted_join(tagged, held, ["rep", *CELL, "slide_id"], ["sample_id"], how="left")
        .withColumn("held_out", F.coalesce("__held", F.lit(False)))
        .drop("__held")
    )


def leakage_report(splits: DataFrame, keys: Sequence[str] = ("rep",)) -> DataFrame:
    """Slides found in more than one partition; no row means no leak."""
    return (
        splits.groupBy(*keys, "slide_id")
        .agg(F.countDistinct("partition").alias("partitions"))
        .where("partitions > 1")
    )


def availability(
    manifest: DataFrame, id_centers: Sequence[str], pool: DataFrame, repetitions: int
) -> DataFrame:
    """Dense (rep, label, centre) counts of the training pool with cell indices;
    an empty cell is an error. Labels come from the whole manifest."""
    counts = pool.groupBy("rep", *CELL).agg(F.count(F.lit(1)).alias("n"))
    center = F.when(F.col("medical_center").isin(list(id_centers)), F.col("medical_center"))
    frame = (
        manifest.agg(
            F.sort_array(F.collect_set("label")).alias("__l"),
            F.sort_array(F.collect_set(center)).alias("__c"),
        )
        .select(F.posexplode("__l").alias("i", "label"), "__c")
        .select("i", "label", F.size("__c").alias("__w"), F.posexplode("__c").alias("j", "medical_center"))
        .withColumn("rep", _numbers(0, repetitions - 1))
    )
    avail = F.when(
        F.col("n").isNull(), F.raise_error(F.lit("a label/centre cell of the training pool is empty"))
    ).otherwise(F.col("n"))
    return frame.join(counts, ["rep", *CELL], "left").select(
        "rep",
        *CELL,
        F.col("i").cast("bigint").alias("i"),
        F.col("j").cast("bigint").alias("j"),
        (F.col("i") * F.col("__w") + F.col("j")).cast("bigint").alias("idx"),
        avail.cast("bigint").alias("avail"),
    )


def split_allocation(
    cells: DataFrame, dataset: str, mode: str, levels: Sequence[float], designs=None
) -> DataFrame | None:
    """Wanted training rows per (rep, split_id, cell); None if there are no levels.

    ``tabulated`` mode uses its own levels; for a dataset without tables it falls
    back to ``custom`` with the levels given.
    """
    if mode not in ("tabulated", "custom"):
        raise ValueError(f"unknown split mode: {mode!r}")
    if mode == "tabulated" and designs is None:
        designs = TABULATED if dataset.lower() in TABULATED_DATASETS else None
        if designs is None:
            mode = "custom"
        else:
            levels = tuple(TABULATED)
    elif mode == "tabulated":
        levels = sorted(designs)
    if not levels:
        return None
    level_rows = [(i + 1, float(level)) for i, level in enumerate(levels)]
    frame = cells.sparkSession.createDataFrame(level_rows, "split_id bigint, correlation_level double")
    if mode == "tabulated":
        return tabulated_allocation(cells, frame, ["rep"], designs)
    return custom_allocation(cells, frame, ["rep"])


def generate_splits(
    manifest: DataFrame,
    dataset: str,
    id_centers: Sequence[str],
    ood_centers: Sequence[str],
    levels: Sequence[float] = (),
    repetitions: int = 3,
    id_test_fraction: float = 0.2,
    seed: int = 0,
    mode: str = "tabulated",
    designs=None,
    check: bool = True,
) -> DataFrame:
    """One long table of train / id_test / ood_test rows per (rep, split_id).

    The held-out slides and the allocation are small and used by several branches
    of the plan, so both are computed once and kept in the scratch folder.
    """
    id_rows = manifest.where(F.col("medical_center").isin(list(id_centers)))
    ood_rows = manifest.where(F.col("medical_center").isin(list(ood_centers)))
    if check:
        if id_rows.isEmpty():
            raise ValueError(f"{dataset}: no rows in the in-distribution centres")
        if ood_rows.isEmpty():
            raise ValueError(f"{dataset}: the out-of-distribution set is empty")
    held = materialize(test_slides(id_rows, id_test_fraction, seed, repetitions), "held")
    split = slide_level_split(id_rows, id_test_fraction, seed, repetitions, held)
    pool = split.where(~F.col("held_out")).drop("held_out")
    if check:
        sides = split.select(
            "rep", "slide_id", F.when(F.col("held_out"), "id_test").otherwise("train").alias("partition")
        )
        if not leakage_report(sides).isEmpty():
            raise RuntimeError("slide leakage between train and id_test")
    cells = availability(manifest, id_centers, pool, repetitions)
    allocation = split_allocation(cells, dataset, mode, levels, designs)
    if allocation is None:
        return manifest.sparkSession.createDataFrame([], SPLIT_ROW)
    allocation = materialize(allocation, "allocation")
    realized = cramers_v(
        allocation.withColumnRenamed("want", "n"), "label", "medical_center", ["rep", "split_id"]
    ).select("rep", "split_id", F.col("cramers_v").alias("cramers_v_realized"))
    levels_used = allocation.select("split_id", "correlation_level").distinct()
    per_split = realized.join(levels_used, "split_id")  # one row per repetition and level
    count = int(levels_used.agg(F.max("split_id")).first()[0])
    columns = ["rep", "split_id", "sample_id", *CELL, "slide_id"]
    key = [seed, F.col("rep"), F.col("split_id"), F.col("sample_id")]
    train = sample_per_cell(
        pool.withColumn("split_id", _numbers(1, count)).select(*columns),
        allocation,
        ["rep", "split_id", *CELL],
        ["sample_id"],
        key,
    ).withColumn("partition", F.lit("train"))
    tests = (
        split.where("held_out")
        .withColumn("partition", F.lit("id_test"))
        .drop("held_out")
        .unionByName(
            ood_rows.withColumn("rep", _numbers(0, repetitions - 1)).withColumn(
                "partition", F.lit("ood_test")
            )
        )
        .withColumn("split_id", _numbers(1, count))
        .select(*columns, "partition")
    )
    rows = train.unionByName(tests)
    return (
        salted_join(rows, per_split, ["rep", "split_id"], ["sample_id"]).select(
            "sample_id",
            *CELL,
            "slide_id",
            "partition",
            "correlation_level",
            F.col("correlation_level").alias("cramers_v_target"),
            "cramers_v_realized",
            F.lit(dataset).alias("dataset"),
            "rep",
            "split_id",
        )
    )


def sample_without_replacement(
    df: DataFrame, n: int, cell: Sequence[str], identity: str, seed: int = 0
) -> DataFrame:
    """``n`` rows of each cell by seeded hash order."""
    wanted = df.select(*cell).distinct().withColumn("want", F.lit(int(n)))
    return sample_per_cell(df, wanted, list(cell), [identity], [seed, F.col(identity)])


# --- storage --------------------------------------------------------------------


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.partitionBy("dataset", "rep", "split_id").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SPLIT_ROW).parquet(path)


def read_split_files(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Splits kept as CSV with a header, ``rep_<n>/split_<n>.csv`` below ``root``.

    Repetition and split are those of the path; columns that a file lacks are NULL.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).csv(f"{root.rstrip('/')}/rep_*/split_*.csv")
    numbers = r"rep_(\d+)/split_(\d+)\.csv"
    named = {
        "dataset": F.lit(dataset),
        "rep": F.regexp_extract(F.col("_metadata.file_path"), numbers, 1),
        "split_id": F.regexp_extract(F.col("_metadata.file_path"), numbers, 2),
    }
    columns = []
    for f in SPLIT_ROW.fields:
        value = named.get(f.name, F.col(f.name) if f.name in raw.columns else F.lit(None))
        columns.append(value.cast(f.dataType).alias(f.name))
    return raw.select(*columns)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Content hash (1 row) that no order of rows or columns changes: number of rows, sum
    and xor of parts of the md5 of each row's named values."""
    values = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\\N"))) for c in sorted(df.columns)]
    digits = df.select(F.md5(F.concat_ws("|", *values)).alias("row"))
    return digits.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(hex_to_long(F.substring("row", 1, 15)).cast("decimal(38,0)")), F.lit(0)).alias("s"),
        F.coalesce(F.bit_xor(hex_to_long(F.substring("row", 16, 15))), F.lit(0)).alias("x"),
    ).select(F.sha2(F.concat_ws("|", "n", "s", "x"), 256).alias("fingerprint"))


def entry_name(manifest: DataFrame, dataset: str, params: dict) -> DataFrame:
    """One row (name, document): what a cache entry is called and what it was made from."""
    given = "\n".join(f"{name} = {params[name]!r}" for name in sorted(params))
    document = F.concat_ws("\n", F.lit(dataset), F.lit(given), F.col("fingerprint"))
    return table_fingerprint(manifest).select(F.sha2(document, 256).alias("name"), document.alias("document"))


def cached_splits(
    manifest: DataFrame, dataset: str, cache_root: str, shared_roots: Sequence[str] = (), **params
) -> tuple[DataFrame, bool]:
    """Stored splits of the same content and parameters, or freshly made ones.

    Looks below ``cache_root``, then below each of ``shared_roots``, which are only
    read. Returns the splits and whether there was an entry. The document of an entry
    is written last, so an interrupted write is never mistaken for one.
    """
    spark = manifest.sparkSession
    entry = entry_name(manifest, dataset, params)
    wanted = entry.first()
    for root in (cache_root, *shared_roots):
        found = f"{root.rstrip('/')}/{wanted['name']}"
        try:
            documents = spark.read.parquet(f"{found}/document")
        except AnalysisException:
            continue
        if not documents.where(F.col("document") == wanted["document"]).isEmpty():
            return read_splits(spark, f"{found}/splits"), True
    own = f"{cache_root.rstrip('/')}/{wanted['name']}"
    splits = generate_splits(manifest, dataset, **params)
    splits.write.mode("overwrite").partitionBy("dataset", "rep", "split_id").parquet(f"{own}/splits")
    entry.write.mode("overwrite").parquet(f"{own}/document")
    return read_splits(spark, f"{own}/splits"), False
