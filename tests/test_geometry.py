import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, geometry as G, text
from tessera.functions.sqlfunctions import register_sql_functions
from tests.conftest import one


def value(spark, column):
    return one(spark.range(1).select(column.alias("v")))["v"]


def test_spacing_round_trip(spark):
    assert value(spark, G.spacing_to_level0_px(512, 1.0, 0.25)) == 2048
    assert value(spark, G.level0_to_spacing_px(2048, 1.0, 0.25)) == 512


def test_rounding_is_half_to_even(spark):
    assert value(spark, G.round_px(F.lit(2.5))) == 2
    assert value(spark, G.round_px(F.lit(3.5))) == 4


def test_spacing_must_be_positive(spark):
    with pytest.raises(Exception, match="must be positive"):
        value(spark, G.spacing_to_level0_px(512, 1.0, 0.0))


def test_context_box(spark):
    box = value(spark, G.context_box_level0(5000, 7000, 512, 1.0, 0.25))
    assert tuple(box) == (3976, 5976, 6024, 8024)


def test_center_bounds(spark):
    inside = lambda x: value(spark, G.center_in_bounds(x, 1024, 512, 1.0, 0.25, 9000, 9000))
    assert inside(1024) and not inside(1023)


@pytest.mark.parametrize("size,snapped", [(1, 16), (16, 16), (24, 16), (25, 32), (224, 224), (231, 224)])
def test_snap_ties_go_down(spark, size, snapped):
    assert value(spark, G.snap_to_multiple(size, 16)) == snapped


@pytest.mark.parametrize(
    "mpp,expected",
    [(0.5, (0.252, "fallback_from_finer")), (1.0, (1.008, "native_or_close")), (0.1, (0.252, "fallback_from_coarser"))],
)
def test_source_spacing(spark, mpp, expected):
    spacings = F.array(F.lit(4.032), F.lit(0.252), F.lit(1.008))
    assert tuple(value(spark, G.choose_source_spacing(spacings, mpp, 0.05))) == expected


def test_empty_pyramid_is_an_error(spark):
    with pytest.raises(Exception, match="no pyramid spacing"):
        value(spark, G.choose_source_spacing(F.array().cast("array<double>"), 1.0, 0.05))


def test_best_level(spark):
    spacings = F.array(F.lit(0.25), F.lit(1.0), F.lit(4.0))
    assert tuple(value(spark, G.best_level_for_spacing(spacings, 1.0, 0.1))) == (1, True)
    assert tuple(value(spark, G.best_level_for_spacing(spacings, 3.5, 0.1))) == (2, False)


@pytest.mark.parametrize("x0,y0,tokens", [(0, 0, 64), (3, 0, 72), (3, 5, 81)])
def test_box_token_counts(spark, x0, y0, tokens):
    b = G.box(*[F.lit(float(v)) for v in (x0, y0, x0 + 128, y0 + 128)])
    assert len(value(spark, G.box_to_tokens(b, 32, 32, 16))) == tokens


def test_box_beyond_the_grid_still_gives_a_token(spark):
    b = G.box(F.lit(600.0), F.lit(600.0), F.lit(700.0), F.lit(700.0))
    assert value(spark, G.box_to_tokens(b, 32, 32, 16)) == [0]


def test_coverage_of_an_aligned_box_is_exact(spark):
    b = G.box(F.lit(16.0), F.lit(16.0), F.lit(48.0), F.lit(48.0))
    tokens = G.box_to_tokens(b, 8, 8, 16)
    assert tuple(value(spark, G.coverage_mismatch(b, tokens, 8, 8, 16))) == (0.0, 0.0)


def test_clip_keeps_a_pixel(spark):
    b = G.box(F.lit(300.0), F.lit(-5.0), F.lit(310.0), F.lit(-1.0))
    assert tuple(value(spark, G.clip_box(b, 256, 256))) == (255.0, 0.0, 256.0, 1.0)


def test_threshold_schedule(spark):
    assert value(spark, arrays.threshold_schedule(0.5, 0.3, 0.1)) == [0.5, 0.4, 0.3]
    assert value(spark, arrays.threshold_schedule(0.25, 0.1, 0.05)) == [0.25, 0.2, 0.15, 0.1]
    assert value(spark, arrays.threshold_schedule(0.3, 0.3, 0.1)) == [0.3]
    assert value(spark, arrays.threshold_schedule(0.5, 0.1, 0.1, "skip_anchor")) == [0.5]


@pytest.mark.parametrize("policy", ["skip_slide", "other"])
def test_unknown_policy_is_rejected(policy):
    with pytest.raises(ValueError):
        arrays.threshold_schedule(0.5, 0.1, 0.1, policy)


def test_names(spark):
    assert value(spark, text.display_anchor_name(F.lit("s1_0000004"))) == "A005"
    assert value(spark, text.display_anchor_name(F.lit("free"))) == "free"
    assert value(spark, text.sanitize_token(F.lit("  a//b  c--"))) == "a-b-c"
    assert value(spark, text.sanitize_token(F.lit("///"))) == "x"
    assert value(spark, text.output_stem(F.lit(7), F.lit("a b"), F.lit("a_0001"))) == "s007_a-b_A002"
    assert value(spark, text.path_stem(F.lit("/x/y.z/slide.ome.tif"))) == "slide.ome"


def test_levels(spark):
    assert value(spark, text.parse_levels(F.lit("0, 0.5,1.0"))) == [0.0, 0.5, 1.0]
    with pytest.raises(Exception, match="correlation levels"):
        value(spark, text.parse_levels(F.lit("0,1.5")))


def test_sql_functions_match_the_column_functions(spark):
    register_sql_functions(spark)
    row = one(spark.sql("SELECT snap_to_multiple(25, 16) a, spacing_to_level0_px(512, 1.0, 0.25) b"))
    assert (row["a"], row["b"]) == (32, 2048)


def test_vectors(spark):
    assert value(spark, arrays.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    tokens = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))
    assert value(spark, arrays.mean_pool(tokens)) == [2.0, 4.0]
    assert value(spark, arrays.token_complement(F.array(F.lit(1).cast("bigint")), 3)) == [0, 2]
