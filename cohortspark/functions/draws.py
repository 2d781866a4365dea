"""Counter-based random numbers: a pure function of seed and key, so independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13


def digest(seed: int | str, *keys: Column) -> Column:
    """md5 over seed and keys as text; sorts rows in an order that any engine can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def uniform(seed: int | str, *keys: Column) -> Column:
    """A double in [0, 1) from the first 13 hex digits of the digest."""
    head = F.substring(digest(seed, *keys), 1, _HEX_DIGITS)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(float(16**_HEX_DIGITS))
