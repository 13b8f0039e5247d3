"""Keyed uniforms and Gaussians that depend on the row alone, so results do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])


def hashed(seed: int, *parts: Column) -> Column:
    """A 32-bit number as long."""
    return F.conv(F.substring(F.md5(key(seed, *parts)), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1)."""
    return (hashed(seed, *parts) + 0.5) / float(1 << 32)


def gauss(seed: int, *parts: Column) -> Column:
    """Box-Muller on two uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, *parts, F.lit("a")))) * F.cos(2 * math.pi * uniform(seed, *parts, F.lit("b")))


def pick(seed: int, n: Column | int, *parts: Column) -> Column:
    """In 0 to n - 1."""
    return hashed(seed, *parts) % (F.lit(n) if isinstance(n, int) else n)
