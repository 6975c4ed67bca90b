"""Seeded orders, so that random choices repeat and can be checked elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_order(seed: int, purpose: str, *keys: Column) -> Column:
    """A pseudo-random sort key, independent for every purpose."""
    parts = [F.lit(str(seed)), F.lit(purpose), *[key.cast("string") for key in keys]]
    return F.md5(F.concat_ws("|", *parts))
