"""Raw events -> canonical events.

Steps: keep the three funnel event types (an `In` filter the parquet/CSV
reader can push down), parse the time leniently (unparsable -> NULL), drop
rows without time, user or type, make user_id text, and assign the simulated
dimensions from a stable per-row key. Everything is a narrow, per-row
projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit import schema
from funnelkit.functions.dims import with_dimensions

# digits that no calendar format uses (8 digits are a date), and what they count
EPOCH_SECONDS = r"^-?[0-9]{9,11}$"
EPOCH_MILLIS = r"^-?[0-9]{12,14}$"
EPOCH_MICROS = r"^-?[0-9]{15,16}$"
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss z",)


def parse_time(col: Column, dtype: T.DataType) -> Column:
    """Lenient parse to TIMESTAMP_NTZ in the session zone (UTC).

    Text: ISO / `yyyy-MM-dd HH:mm:ss[.ffffff]`, or with a zone suffix such as
    `2019-11-01 00:00:00 UTC`, or an epoch whose number of digits tells its unit:
    9 to 11 seconds, 12 to 14 milliseconds, 15 or 16 microseconds (so 1973 to
    5138 in seconds); anything else becomes NULL. Integers are epoch milliseconds. Timestamps pass
    through.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, T.TimestampType):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return F.timestamp_millis(col).cast("timestamp_ntz")
    text = col.cast("string")
    number = text.try_cast("bigint")
    epoch = (F.when(text.rlike(EPOCH_SECONDS), F.timestamp_seconds(number))
             .when(text.rlike(EPOCH_MILLIS), F.timestamp_millis(number))
             .when(text.rlike(EPOCH_MICROS), F.timestamp_micros(number)))
    parsed = F.coalesce(epoch, F.try_to_timestamp(text))
    for fmt in TIME_FORMATS:
        parsed = F.coalesce(parsed, F.try_to_timestamp(text, F.lit(fmt)))
    return parsed.cast("timestamp_ntz")


def assign_dims(df: DataFrame, key: str = "event_id") -> DataFrame:
    """Add country / device / channel drawn from the row key (see functions.dims)."""
    return with_dimensions(df, key)


def price_of(raw: DataFrame) -> Column:
    """The price as DECIMAL(18,2); NULL where it does not parse or the source has none."""
    return F.col("price").try_cast("decimal(18,2)") if "price" in raw.columns else F.lit(None).cast("decimal(18,2)")


def _checked(raw: DataFrame) -> dict[str, T.DataType]:
    dtypes = dict((f.name, f.dataType) for f in raw.schema.fields)
    missing = {"event_time", "event_type", "user_id"} - set(dtypes)
    if missing:
        raise ValueError(f"raw events lack columns {sorted(missing)}; got {raw.columns}")
    return dtypes


def standardise(raw: DataFrame, key: str = "event_id") -> DataFrame:
    """Canonical events (`schema.CANONICAL_COLUMNS`) from an adapted raw frame.

    `raw` needs event_time, event_type and user_id; `key` names a stable row
    key used for the dimension draw. Sources without one get a 64-bit hash of
    the row's content: deterministic under any partitioning, but not unique
    (identical rows share it, and at ~10^10 rows and beyond distinct rows can
    collide), which only means such rows share their drawn dimensions. `price`
    is kept when present; one that does not parse becomes NULL.
    """
    dtypes = _checked(raw)
    df = raw.where(F.col("event_type").isin(*schema.EVENT_TYPES))
    if key not in dtypes:
        df = df.withColumn(key, F.xxhash64(*[F.col(c) for c in raw.columns]))
    df = df.withColumn("event_time", parse_time(F.col("event_time"), dtypes["event_time"]))
    df = df.dropna(subset=["event_time", "user_id", "event_type"])
    df = assign_dims(df.withColumn("user_id", F.col("user_id").cast("string")), key)
    return df.select(
        F.col(key).cast("bigint").alias("event_id"),
        "event_time", "event_type", "user_id", "country", "device", "channel",
        price_of(raw).alias("price"),
    )


# Why a raw row is set aside. A row with a bad price is still an event, without a price.
BAD_COLUMNS, BAD_TIME, NO_USER, BAD_PRICE = "column_count", "event_time", "user_id", "price"


def standardise_with_rejects(raw: DataFrame, key: str = "event_id", corrupt: str = "_corrupt_record") -> DataFrame:
    """Canonical events and set-aside rows in one frame: canonical columns, rejected, reason, record.

    `rejected = false` rows are those of `standardise`. For each reason a raw row
    gives - a line whose columns do not match the header (`corrupt` holds it), a
    time or price that does not parse, no user - there is one `rejected = true` row
    with the reason and the row as text (the line, else JSON); its canonical
    columns are NULL. Rows of other event types are no events and no rejects.
    """
    dtypes = _checked(raw)
    broken = F.col(corrupt).isNotNull() if corrupt in dtypes else F.lit(False)
    columns = [c for c in raw.columns if c != corrupt]
    df = raw.where(broken | F.col("event_type").isin(*schema.EVENT_TYPES))
    price = price_of(raw)
    text_price = F.trim(F.col("price").cast("string")) if "price" in dtypes else F.lit(None).cast("string")
    time = parse_time(F.col("event_time"), dtypes["event_time"])
    df = df.select("*", broken.alias("__broken"), time.alias("__time"), price.alias("__price"),
                   F.coalesce(F.col(corrupt) if corrupt in dtypes else F.lit(None).cast("string"),
                              F.to_json(F.struct(*columns))).alias("__record"),
                   (F.col(key).try_cast("bigint") if key in dtypes
                    else F.xxhash64(*[F.col(c) for c in columns])).alias("__key"))
    whole = ~F.col("__broken")
    reasons = F.array_compact(F.array(
        F.when(F.col("__broken"), F.lit(BAD_COLUMNS)),
        F.when(whole & F.col("__time").isNull(), F.lit(BAD_TIME)),
        F.when(whole & F.col("user_id").isNull(), F.lit(NO_USER)),
        F.when(whole & F.col("__price").isNull() & (text_price != ""), F.lit(BAD_PRICE))))
    usable = whole & F.col("__time").isNotNull() & F.col("user_id").isNotNull()
    rows = F.concat(F.when(usable, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")), reasons)
    df = df.withColumn("reason", F.explode(rows)).withColumn("rejected", F.col("reason").isNotNull())
    df = assign_dims(df.drop(*[c for c in ("country", "device", "channel") if c in raw.columns]), "__key")
    event = {"event_id": F.col("__key"), "event_time": F.col("__time"), "event_type": F.col("event_type"),
             "user_id": F.col("user_id").cast("string"), **{d: F.col(d) for d in schema.DIMENSIONS}, "price": F.col("__price")}
    return df.select(*[F.when(~F.col("rejected"), c).alias(name) for name, c in event.items()],
                     "rejected", "reason", F.when(F.col("rejected"), F.col("__record")).alias("record"))
