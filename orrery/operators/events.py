"""Event tables from label fragments and a type dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESA = ("Class", "Subclass", "Dimensionality", "Locality", "Length")


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def event_table(labels: DataFrame, types: DataFrame) -> DataFrame:
    """One row per ID: span, sorted distinct channels, category, flags and the type columns ("" where blank).

    A type column depends on the ID alone; were it not so, its largest value counts.
    """
    esa = [c for c in ESA if c in types.columns]
    rows = labels.join(types.select("ID", "Category", *esa), "ID", "left")
    out = rows.groupBy("ID").agg(
        F.min("StartTime").alias("start"),
        F.max("EndTime").alias("end"),
        F.array_sort(F.collect_set("Channel")).alias("channels"),
        F.max(_text(F.col("Category"))).alias("category"),
        *[F.max(_text(F.col(c))).alias(f"esa_{c.lower()}") for c in esa],
    )
    out = out.withColumns({"is_anomaly": F.col("category") == "Anomaly", "is_rare": F.col("category") == "Rare Event"}).withColumnRenamed("ID", "event_id")
    return out.withColumns({f"esa_{c.lower()}": F.lit("") for c in ESA if c not in esa})


def assign_splits(events: DataFrame, path_end: str, official_end: str) -> DataFrame:
    """``split`` and the pool flags; an event that touches a cut is ``boundary``."""
    p, o = (F.lit(t).cast("timestamp_ntz") for t in (path_end, official_end))
    split = F.when((F.col("end") < p) & (F.col("end") < o), "path_train").when(F.col("end") < o, "pretest").when(F.col("start") > o, "test").otherwise("boundary")
    return events.withColumns({"split": split, "in_train_pool": F.col("end") < o, "in_test_pool": F.col("start") > o})


def channel_pairs(events: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per event and channel of the panel; ``dim`` has channel, channel_idx."""
    return events.withColumn("channel", F.explode("channels")).drop("channels").join(dim, "channel")


def label_counts(labels: DataFrame, types: DataFrame, before: str) -> DataFrame:
    """Per channel: distinct events that end before a time, by category."""
    rows = labels.where(F.col("EndTime") < F.lit(before).cast("timestamp_ntz")).join(types.select("ID", "Category"), "ID", "left")
    n = lambda k: F.count_distinct(F.when(F.col("Category") == k, F.col("ID")))
    return rows.groupBy("Channel").agg(F.count_distinct("ID").alias("n_events"), n("Anomaly").alias("n_anomaly"), n("Rare Event").alias("n_rare"))


def occupancy(pairs: DataFrame, guard: int, n_bins: int, rares: bool = False) -> DataFrame:
    """(channel_idx, bin): bins of labelled spans widened by a guard; ``pairs`` has label_lo, label_hi.

    Events of the sealed pool do not occupy; rare events only where asked.
    """
    live = pairs.where(~F.col("in_test_pool"))
    live = live if rares else live.where(~F.col("is_rare"))
    lo, hi = F.greatest(F.lit(0), F.col("label_lo") - guard), F.least(F.lit(n_bins), F.col("label_hi") + guard) - 1
    return live.where(hi >= lo).select("channel_idx", F.explode(F.sequence(lo, hi)).alias("bin")).distinct()
