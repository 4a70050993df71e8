"""Reproducible random draws.

A draw is a hash of its own identity, so it does not depend on how rows are
partitioned, on retries or on which executor computes it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str | int) -> Column:
    """32-bit integer from the md5 of the parts joined with ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform draw strictly inside (0, 1)."""
    return (hash32(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def normal(*parts: Column | str | int) -> Column:
    """Standard normal draw by Box-Muller from two uniforms."""
    u1 = uniform(*parts, "u1")
    u2 = uniform(*parts, "u2")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def draw_ids(n: int) -> Column:
    """Rows 1..n; the number of draws is a parameter, not data."""
    return F.explode(F.sequence(F.lit(1), F.lit(n)))
