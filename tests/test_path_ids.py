"""Paths of a supplier with very many lines do not run into those of another."""

from pyspark.sql import functions as F

from plumbline.sources import panels


def test_paths_of_a_large_supplier(spark, tmp_path):
    lines = spark.range(2 * 2200).select((2 + 2 * (F.col("id") % 2)).alias("l_suppkey"), F.col("id").alias("l_shipdate"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(1).alias("l_partkey"), (F.col("id") + 1.0).alias("l_extendedprice"), F.lit(1.0).alias("l_quantity"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    paths = panels.supplier_paths(spark, str(tmp_path), horizon=1).df
    assert paths.count() == paths.select("side", "path", "t").distinct().count() == 2 * 2199
