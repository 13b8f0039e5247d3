"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separator class of the word rules: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for a row.

    A higher-order function evaluates what its lambda closes over for every
    element; bound to a lambda variable, the value is computed only once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the runs of characters other than space and U+0009 to U+000D (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """``text`` with only A-Z lower-cased; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session (tests) without one gets a temporary one, a cluster has to name it."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class Scratch:
    """Tables written in the shared folder, to cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}"
        self.count = 0

    def place(self, name: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:04d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = self.place(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._orrery_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._orrery_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of tables that are written by now."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
