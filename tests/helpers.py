"""Shared test helpers: canonical micro frames and result comparison."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import types as T

from funnelkit import schema

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)


def events_df(spark, rows):
    """rows: tuples (user_id, event_type, event_time, country, device, channel[, price])."""
    full = []
    for i, r in enumerate(rows):
        user, etype, t, country, device, channel = r[:6]
        price = Decimal(str(r[6])) if len(r) > 6 and r[6] is not None else None
        full.append((i, t, etype, user, country, device, channel, price))
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.CANONICAL_SCHEMA.fields])
    return spark.createDataFrame(full, nullable)


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def as_dicts(df):
    return [r.asDict() for r in df.collect()]
