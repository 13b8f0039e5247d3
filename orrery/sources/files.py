"""Readers and writers with fixed schemas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "ID string, Channel string, StartTime string, EndTime string"
TYPES = "ID string, Class string, Subclass string, Category string, Dimensionality string, Locality string, Length string"
PANEL = "channel string, channel_idx int, bin bigint, ts timestamp_ntz, y double, cnt bigint"


def load_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def naive_utc(c) -> F.Column:
    """A time string, with or without an offset, as naive UTC."""
    text = F.trim(c)
    zoned = F.try_to_timestamp(text)
    offset = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(offset, F.convert_timezone(F.current_timezone(), F.lit("UTC"), zoned.cast("timestamp_ntz"))).otherwise(zoned.cast("timestamp_ntz"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(LABELS).csv(path, header=True)
    return raw.withColumns({"StartTime": naive_utc(F.col("StartTime")), "EndTime": naive_utc(F.col("EndTime"))})


def read_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TYPES).csv(path, header=True)


def read_types_or_none(spark: SparkSession, path: str) -> DataFrame:
    """The type table; without a file, an empty one."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return read_types(spark, path)
    return spark.createDataFrame([], TYPES)


def read_panel(spark: SparkSession, path: str, cut: str | None = None) -> DataFrame:
    """A stored panel, cropped before ``cut``; the filter reaches the scan."""
    rows = spark.read.schema(PANEL).parquet(path)
    return rows.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz")) if cut else rows


def write_panel(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").partitionBy("channel").parquet(path)


def write_rows(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table; for CSV, nested columns become JSON text and columns are in order of name."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in sorted(rows.dtypes)]
        rows.select(*flat).write.mode("overwrite").csv(path, header=True)
    else:
        rows.write.mode("overwrite").format(kind).save(path)


def write_report(path: str, report: dict) -> None:
    """A phase's report: ok, skipped, reason and counts."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, default=str, sort_keys=True))


def clean_key(c) -> F.Column:
    """A name with everything but letters, digits, dot, underscore and hyphen replaced by an underscore."""
    return F.regexp_replace(c, "[^0-9A-Za-z._-]", "_")
