"""Canonical event schema and the closed vocabularies of the funnel model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the analysed product's definitions for the
# reports to mean the same thing. Stated once, in natural order.
# ---------------------------------------------------------------------------
EVENT_TYPES = ("view", "cart", "purchase")

COUNTRIES = ("DE", "NL", "BE", "FR")
COUNTRY_WEIGHTS = (0.45, 0.25, 0.15, 0.15)

DEVICES = ("mobile", "desktop", "tablet")
DEVICE_WEIGHTS = (0.62, 0.32, 0.06)

CHANNELS = ("organic_search", "paid_social", "email", "direct", "paid_search", "influencer")
CHANNEL_WEIGHTS = (0.28, 0.22, 0.18, 0.12, 0.12, 0.08)

# raw vocabulary of the retail / heuristic sources mapped onto EVENT_TYPES
RAW_EVENT_MAP = {"view": "view", "addtocart": "cart", "transaction": "purchase"}

# labels of the stage report
STAGE_LABELS = ("Viewed", "Added to Cart", "Purchased")

# report thresholds
MIN_ROWS = 100_000
REPEAT_WINDOW_DAYS = 60
# ---------------------------------------------------------------------------

# Dimension columns of the canonical table.
DIMENSIONS = ("country", "device", "channel")

CANONICAL_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType(), True),
        T.StructField("event_time", T.TimestampNTZType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("country", T.StringType(), False),
        T.StructField("device", T.StringType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("price", T.DecimalType(18, 2), True),
    ]
)

CANONICAL_COLUMNS = tuple(f.name for f in CANONICAL_SCHEMA.fields)
