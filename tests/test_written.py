"""Results that are written as a driver does it, by another plan than that of collect()."""

from rulewright import operators


def test_counted_conflicts_can_be_written(spark, sf, tmp_path):
    found = operators.from_tables(spark, "evl_09_detected", sf)
    found.withColumns({}).write.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, found.collect())) != []
