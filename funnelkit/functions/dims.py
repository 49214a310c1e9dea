"""Seeded weighted categorical draw per row, independent of partitioning.

The analysed product draws country/device/channel per event from a seeded
random generator; that depends on row order, so it cannot be reproduced under
a distributed scan. Here the draw is a salted md5 of a stable row key: its
first 4 hex digits are a uniform number in [0, 65536) compared (as text)
against the cumulative weights x 65536. Any engine and any partitioning gives
the same assignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit import schema


def thresholds(weights) -> list[str]:
    """Cumulative weight boundaries as 4-digit lower-case hex strings."""
    out, acc = [], 0.0
    for w in weights[:-1]:
        acc += w
        out.append(f"{round(acc * 65536):04x}")
    return out


DRAWS = {
    "country": (schema.COUNTRIES, schema.COUNTRY_WEIGHTS),
    "device": (schema.DEVICES, schema.DEVICE_WEIGHTS),
    "channel": (schema.CHANNELS, schema.CHANNEL_WEIGHTS),
}


def draw_hash(key: Column, salt: str) -> Column:
    """substr(md5(salt || ':' || key), 1, 4): a uniform 16-bit number as hex text."""
    return F.substring(F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string"))), 1, 4)


def pick_from_hash(h: Column, values, weights) -> Column:
    """CASE over the hash prefix against the cumulative thresholds."""
    expr = None
    for value, bound in zip(values[:-1], thresholds(weights)):
        expr = F.when(h < F.lit(bound), F.lit(value)) if expr is None else expr.when(h < F.lit(bound), F.lit(value))
    return expr.otherwise(F.lit(values[-1]))


def with_dimensions(df: DataFrame, key: str) -> DataFrame:
    """Add country / device / channel drawn from column `key`.

    The md5 prefix is projected first and the CASE applied in a second
    projection: Catalyst does not collapse a non-cheap expression into several
    references, so each hash is computed once per row instead of once per
    CASE branch. Unused dimensions are pruned by the optimizer.
    """
    hashed = df.withColumns({f"_h_{d}": draw_hash(F.col(key), d) for d in DRAWS})
    picked = hashed.withColumns({d: pick_from_hash(F.col(f"_h_{d}"), *DRAWS[d]) for d in DRAWS})
    return picked.drop(*[f"_h_{d}" for d in DRAWS])
