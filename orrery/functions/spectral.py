"""Spectra of windows: Arrow batches through NumPy's FFT."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type objects, as a type in text form needs a running session when this module is imported.
DOUBLES = T.ArrayType(T.DoubleType())
PEAK = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("amplitude", T.DoubleType())])


@F.pandas_udf(DOUBLES)
def power(x: pd.Series) -> pd.Series:
    """Squared sizes of the bins 0 to W / 2 of the real Fourier transform."""
    return x.map(lambda v: np.abs(np.fft.rfft(np.asarray(v, float))) ** 2)


@F.pandas_udf(PEAK)
def dominant(x: pd.Series) -> pd.DataFrame:
    """The strongest bin but 0 (the lowest of equals) and its amplitude 2 |X| / W."""
    rows = []
    for v in x:
        a = np.asarray(v, float)
        s = np.round(2 * np.abs(np.fft.rfft(a - a.mean()))[1:] / len(a), 12)
        rows.append((int(s.argmax()) + 1, float(s.max())) if len(s) else (0, 0.0))
    return pd.DataFrame(rows, columns=["bin", "amplitude"])


@F.pandas_udf(DOUBLES)
def log_bands(x: pd.Series) -> pd.Series:
    """log(1e-8 + mean power) of four bands of about equal width over all bins of the standardised window."""

    def of(v: np.ndarray) -> np.ndarray:
        a = np.asarray(v, float)
        d = a.std()
        p = np.abs(np.fft.rfft((a - a.mean()) / (d if d >= 1e-8 else 1.0))) ** 2
        cuts = [len(p) * i // 4 for i in range(5)]
        return np.log(1e-8 + np.array([p[i:j].mean() if j > i else 0.0 for i, j in zip(cuts, cuts[1:], strict=False)]))

    return x.map(of)


def slow(n_keep: int):
    """A UDF for the part of a window in the first ``n_keep`` bins."""

    @F.pandas_udf(DOUBLES)
    def of(x: pd.Series) -> pd.Series:
        def keep(v: np.ndarray) -> np.ndarray:
            s = np.fft.rfft(np.asarray(v, float))
            s[n_keep:] = 0
            return np.fft.irfft(s, len(v))

        return x.map(keep)

    return of
