"""A store of generated galleries: one table partitioned by method and fold, and a manifest of what is there.

Static galleries have fold -1. Asking for galleries gives their rows and those that are
missing; the table is read by its partitions, so what was not asked for is not scanned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "donor_id long, channel_idx int, x array<double>, method string, fold int"
STATIC = -1


def save(rows: DataFrame, place: str) -> None:
    """Add galleries (method, fold or none, donor_id, channel_idx, x) to the store; one that is there is replaced."""
    own = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(STATIC))
    own = own.select("donor_id", F.col("channel_idx").cast("int").alias("channel_idx"), "x", "method", F.coalesce(F.col("fold").cast("int"), F.lit(STATIC)).alias("fold"))
    own.repartition("method", "fold", F.pmod(F.xxhash64("donor_id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "fold").parquet(f"{place}/rows")


def present(spark: SparkSession, place: str) -> DataFrame:
    """(method, fold, n) of the galleries in the store; none of a place without one."""
    rows = _rows(spark, place)
    return rows.groupBy("method", "fold").agg(F.count("*").alias("n"))


def _rows(spark: SparkSession, place: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(f"{place}/rows")


def load(spark: SparkSession, place: str, wanted: list[tuple[str, int]]) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted galleries, (method, fold) of those that are missing); a static one stands in for any fold that has none of its own."""
    asked = spark.createDataFrame(sorted(set(wanted)), "method string, fold int")
    have = present(spark, place).where("n > 0").select("method", "fold")
    exact = asked.join(have, ["method", "fold"], "left_semi").withColumn("from", F.col("fold"))
    stand_in = asked.join(have, ["method", "fold"], "left_anti").join(have.where(F.col("fold") == STATIC).select("method"), "method", "left_semi").withColumn("from", F.lit(STATIC))
    found = exact.unionByName(stand_in)
    pairs = [(r["method"], r["fold"], r["from"]) for r in found.collect()]  # as many as were asked for
    missing = asked.join(found, ["method", "fold"], "left_anti")
    if not pairs:
        return spark.createDataFrame([], ROWS), missing
    take = None
    for method, origin in sorted({(m, o) for m, _, o in pairs}):
        one = (F.col("method") == method) & (F.col("fold") == origin)
        take = one if take is None else take | one
    rows = _rows(spark, place).where(take).withColumnRenamed("fold", "from")
    return rows.join(F.broadcast(spark.createDataFrame(pairs, "method string, fold int, from int")), ["method", "from"]).select("donor_id", "channel_idx", "x", "method", "fold"), missing
