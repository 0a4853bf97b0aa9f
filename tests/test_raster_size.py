"""Pages as large as what is on them."""

from papergrid.plans.queries import raster_components, raster_lines


def test_late_turns_are_drawn(spark, tmp_path):
    rows = [(1, 0, "user", "short"), (1, 30, "assistant", "x" * 90), (2, 2, "user", "t")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(tuple(r) for r in raster_components(spark, str(tmp_path)).select("conv_id", "x1", "y1", "y2").collect())
    assert got == [(1, 0, 0, 16), (1, 0, 600, 616), (1, 200, 0, 16), (1, 200, 600, 616), (2, 0, 40, 56), (2, 200, 40, 56)]
    lines = sorted(tuple(r) for r in raster_lines(spark, str(tmp_path)).select("conv_id", "x1", "y1", "x2").collect())
    assert lines == [(1, 5, 18, 400), (1, 5, 618, 400), (2, 5, 58, 400)]
