"""Daily weather payloads: parallel JSON arrays to one row per day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.columns import compute_once

# Payload keys and the column each becomes.
KEYS = {
    "time": "date",
    "temperature_2m_max": "temperature_max",
    "temperature_2m_min": "temperature_min",
    "temperature_2m_mean": "temperature_mean",
    "precipitation_sum": "precipitation_sum",
    "rain_sum": "rain_sum",
    "snowfall_sum": "snowfall_sum",
    "wind_speed_10m_max": "wind_speed_max",
    "wind_speed_10m_mean": "wind_speed_mean",
    "relative_humidity_2m_mean": "relative_humidity_mean",
    "soil_temperature_0_to_7cm_mean": "soil_temp_mean",
    "soil_moisture_0_to_7cm_mean": "soil_moisture_mean",
}
_SCHEMA = "daily struct<" + ", ".join(
    f"{k}: array<{'string' if k == 'time' else 'double'}>" for k in KEYS
) + ">"


_PARSED, _NAMES = "_daily", "_names"


def _parsed(payloads: DataFrame, payload_col: str) -> DataFrame:
    """Add the payload's arrays and the names of its keys, each parsed once."""
    payload = F.col(payload_col)
    return compute_once(
        payloads,
        {
            _PARSED: F.from_json(payload, _SCHEMA)["daily"],
            _NAMES: F.json_object_keys(F.get_json_object(payload, "$.daily")),
        },
    )


def _error() -> Column:
    """What is wrong with a parsed payload, or null."""
    missing = F.array_except(F.array(*[F.lit(k) for k in KEYS]), F.col(_NAMES))
    lengths = F.array_distinct(F.array(*[F.size(F.col(_PARSED)[k]) for k in KEYS]))
    return (
        F.when(F.col(_NAMES).isNull(), "payload is missing the 'daily' key")
        .when(F.size(missing) > 0, F.concat(F.lit("payload is missing daily variables: "), F.array_join(missing, ", ")))
        .when(F.size(lengths) > 1, "daily variables differ in length")
    )


def unpivot_daily(payloads: DataFrame, *keep: str, payload_col: str = "payload", strict: bool = True) -> DataFrame:
    """One row per day and payload, other keys ignored.

    ``strict`` fails the job on a bad payload; otherwise bad payloads give no
    rows, and :func:`bad_payloads` lists them.
    """
    source, error = _parsed(payloads.select(*keep, payload_col), payload_col), _error()
    if strict:
        source = source.where(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True))
    else:
        source = source.where(error.isNull())
    daily = F.col(_PARSED)
    return source.select(*keep, F.inline(F.arrays_zip(*[daily[k].alias(k) for k in KEYS]))).select(
        *keep, *[F.col(k).cast("date").alias(c) if k == "time" else F.col(k).alias(c) for k, c in KEYS.items()]
    )


def bad_payloads(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Payloads that cannot be used, with the reason."""
    found = _parsed(payloads, payload_col).withColumn("error", _error()).where(F.col("error").isNotNull())
    return found.drop(_PARSED, _NAMES)
