"""Segment selection (the dashboard's country x device multi-select)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_filter(events: DataFrame, countries: Sequence[str], devices: Sequence[str]) -> DataFrame:
    """Events whose country and device are both selected.

    An empty selection is an error (nothing to show); an empty result is just
    an empty frame. `isin` lists reach the parquet reader as pushed filters.
    """
    if not countries or not devices:
        raise ValueError("select at least one country and one device")
    return events.where(F.col("country").isin(*countries) & F.col("device").isin(*devices))
