"""Chance from row keys: the same on every run, whatever the partitions, and in any engine that has MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest that are used: 52 bits, so that a share is an exact double.
DIGITS = 13


def share(seed: int, *keys: Column | str) -> Column:
    """A number from 0 to below 1 from seed and keys as text, joined by a bar; null keys count as empty."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") / F.lit(float(16**DIGITS))
