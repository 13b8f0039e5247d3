"""Raw channel series in archives: one file a channel, read and decoded in tasks.

``channel_x.zip`` has one member, ``channel_x.pkl`` none: a pickled series or table with
a time index. Only columns are taken from a pickle: names that do not build an array, an
index, a series or a table are an error, so no code of a file is run. A zip may
hold a CSV file (time, value, with a header) instead.

Defined cases: of a zip and a plain file of one channel the zip counts; a table gives the
column with the channel's name, or else its first; times with an offset become UTC without one; rows without a
time are left out, missing values are null; an empty archive has no rows; other members are an error.
A file is decoded by one task, whole, as the format has no smaller part; files spread over tasks.
"""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "channel string, ts timestamp_ntz, seq long, value double"
SLICE = 100_000

# What pickled columns consist of.
BUILDERS = {
    "pandas.core.series": {"Series"},
    "pandas.core.frame": {"DataFrame"},
    "pandas.core.internals.managers": {"SingleBlockManager", "BlockManager"},
    "pandas._libs.internals": {"_unpickle_block"},
    "pandas.core.internals.blocks": {"new_block"},
    "pandas.core.indexes.base": {"Index", "_new_Index"},
    "pandas.core.indexes.datetimes": {"DatetimeIndex", "_new_DatetimeIndex"},
    "pandas.core.indexes.range": {"RangeIndex"},
    "pandas.core.arrays.datetimes": {"DatetimeArray"},
    "pandas.core.dtypes.dtypes": {"DatetimeTZDtype"},
    "pandas._libs.arrays": {"__pyx_unpickle_NDArrayBacked"},
    "pandas._libs.tslibs.offsets": {"Second", "Minute", "Hour", "Day"},
    "pandas._libs.tslibs.timezones": {"utc"},
    "numpy": {"ndarray", "dtype"},
    "numpy.core.multiarray": {"_reconstruct", "scalar"},
    "numpy._core.multiarray": {"_reconstruct", "scalar"},
    "numpy.core.numeric": {"_frombuffer"},
    "numpy._core.numeric": {"_frombuffer"},
    "datetime": {"datetime", "timedelta", "timezone"},
    "pytz": {"_UTC"},
    "builtins": {"slice"},
    "_codecs": {"encode"},
}


class Columns(pickle.Unpickler):
    """Reads columns and nothing else."""

    def find_class(self, module: str, name: str):
        if name not in BUILDERS.get(module, ()):
            raise pickle.UnpicklingError(f"{module}.{name} is not part of a column")
        return super().find_class(module, name)


def _series(content: bytes, path: str, channel: str) -> pd.Series:
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            if not names:
                return pd.Series([], dtype=float, index=pd.DatetimeIndex([]))
            name, content = names[0], z.read(names[0])
        if name.endswith(".csv"):
            got = pd.read_csv(io.BytesIO(content))
            return pd.Series(got.iloc[:, 1].to_numpy(), index=pd.to_datetime(got.iloc[:, 0], utc=True))
    got = Columns(io.BytesIO(content)).load()
    if isinstance(got, pd.DataFrame):
        got = got[channel] if channel in got.columns else got.iloc[:, 0]
    if not isinstance(got, pd.Series):
        raise ValueError(f"{path} holds no series")
    return got


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, channel, content in zip(b.path, b.channel, b.content, strict=True):
            s = _series(content, path, channel)
            at = pd.DatetimeIndex(s.index)
            at = at.tz_convert("UTC").tz_localize(None) if at.tz is not None else at
            rows = pd.DataFrame({"channel": channel, "ts": at.astype("datetime64[us]"), "seq": np.arange(len(s)), "value": pd.to_numeric(s, errors="coerce").to_numpy(float)})
            rows = rows[rows.ts.notna()]
            for i in range(0, len(rows), SLICE):
                yield rows.iloc[i : i + SLICE]


def present(spark: SparkSession, folder: str, channels: list[str]) -> DataFrame:
    """(channel, path): the file of each requested channel, null if it is missing. Names alone are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zip,pkl}").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)\.(?:zip|pkl)$", 1)
    found = files.groupBy(name.alias("channel")).agg(F.max("path").alias("path"))  # of .pkl and .zip the latter
    return spark.createDataFrame([(c,) for c in dict.fromkeys(channels)], "channel string").join(found, "channel", "left")


def read(spark: SparkSession, folder: str, channels: list[str]) -> DataFrame:
    """Samples (channel, ts, seq, value) of the requested channels, in ``seq`` as they lie in their files; missing channels have no rows."""
    # One path for a requested channel.
    paths = [r["path"] for r in present(spark, folder, channels).where("path IS NOT NULL").collect()]
    if not paths:
        return spark.createDataFrame([], RAW)
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.(?:zip|pkl)$", 1).alias("channel"), "content").mapInPandas(_decoded, RAW)


def scout(spark: SparkSession, folder: str, channels: list[str], cut: str, bin_seconds: int, width: int) -> DataFrame:
    """A row for each requested channel: missing, empty (no value before ``cut``), and the window statistics of its bins.

    A channel's grid begins at its own first value; of samples with one time the last counts.
    """
    from orrery.functions import shared
    from orrery.operators import panel

    raw = shared.written(panel.dedupe_keep_last(read(spark, folder, channels), "seq"), "raw")
    binned = panel.mean_bins(raw, bin_seconds, cut)
    first = binned.where("cnt > 0").groupBy("channel").agg(F.min("bin").alias("from"))
    # One row a channel.
    own = shared.written(binned.join(F.broadcast(first), "channel").where(F.col("bin") >= F.col("from")).drop("from"), "raw-bins")
    stats = panel.window_report(own, width).join(panel.snap_report(own, width), "channel")
    rows = present(spark, folder, channels).join(stats, "channel", "left")
    missing = F.col("path").isNull()
    return rows.select("channel", missing.alias("missing"), (~missing & F.col("n_windows").isNull()).alias("empty"), *stats.columns[1:])
