"""Landed API documents to rows. Each document is parsed where it is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.scalars import from_tenths
from fieldlens.schemas import CLIMATE_PARAMETERS, LIVE_FEATURES

# fixed values: document shapes
POWER_DOC = "properties struct<parameter: map<string, map<string, double>>>"
FORECAST_DOC = "daily struct<time: array<string>, {arrays}>"
STATION_DOC = "results array<struct<datatype: string, value: double>>"
MISSING = -999.0


def flatten_power(
    docs: DataFrame,
    value: str = "value",
    field: str = "field_id",
    parameters: Sequence[str] = tuple(CLIMATE_PARAMETERS),
) -> DataFrame:
    """Documents {parameter: {yyyyMMdd: number}} to one row per (field, date).

    The sentinel becomes null. The series are exploded to (date, parameter, number) and regrouped,
    which stays linear in the length of a series.
    """
    parsed = docs.select(field, F.from_json(value, POWER_DOC).alias("doc"))
    series = parsed.select(
        field, F.explode("doc.properties.parameter").alias("parameter", "days")
    ).filter(F.col("parameter").isin(*parameters))
    cells = series.select(field, "parameter", F.explode("days").alias("day", "x"))
    return cells.groupBy(
        field, F.try_to_timestamp("day", F.lit("yyyyMMdd")).alias("date")
    ).agg(
        *[
            F.max(
                F.when(F.col("parameter") == p, F.nullif(F.col("x"), F.lit(MISSING)))
            ).alias(p)
            for p in parameters
        ]
    )


def _parsed_once(value: str, shape: str) -> Column:
    """The document as `_doc`; a generated column is computed once for all its later uses."""
    return F.explode(F.array(F.from_json(value, shape))).alias("_doc")


def _forecast(docs: DataFrame, value: str, mapping: Mapping[str, str]) -> DataFrame:
    arrays = ", ".join(f"{source}: array<double>" for source in mapping)
    return docs.select("*", _parsed_once(value, FORECAST_DOC.format(arrays=arrays)))


def flatten_forecast(
    docs: DataFrame,
    today: date,
    value: str = "value",
    field: str = "field_id",
    mapping: Mapping[str, str] = LIVE_FEATURES,
) -> DataFrame:
    """Today's element (the first) of each forecast array; absent arrays give null."""
    parsed = _forecast(docs, value, mapping)
    return parsed.select(
        field,
        *[
            F.try_element_at(f"_doc.daily.{source}", F.lit(1)).alias(name)
            for source, name in mapping.items()
        ],
        F.lit(today.isoformat()).alias("forecast_date"),
    )


def flatten_forecast_days(
    docs: DataFrame,
    value: str = "value",
    field: str = "field_id",
    mapping: Mapping[str, str] = LIVE_FEATURES,
) -> DataFrame:
    """One row per forecast day, `day_offset` 0 being today."""
    parsed = _forecast(docs, value, mapping)
    rows = parsed.select(field, "_doc", F.posexplode("_doc.daily.time").alias("day_offset", "day"))
    return rows.select(
        field,
        "day_offset",
        F.try_to_timestamp("day").cast("date").alias("date"),
        *[
            F.get(f"_doc.daily.{source}", F.col("day_offset")).alias(name)
            for source, name in mapping.items()
        ],
    )


def flatten_station(
    docs: DataFrame,
    stations: DataFrame,
    at: Column,
    value: str = "value",
    station: str = "station_id",
    source: str = "noaa_ghcn",
) -> DataFrame:
    """Documents {results: [{datatype, value}]} in tenths to weather events.

    Temperature is the maximum, else the minimum (0 degrees is a value); no rain entry means 0.
    `stations` maps station_id to field_id; a station that is not listed belongs to `unknown`.
    """
    parsed = docs.select(station, _parsed_once(value, STATION_DOC))
    results = F.coalesce(
        F.col("_doc.results"),
        F.array().cast("array<struct<datatype: string, value: double>>"),
    )

    def reading(name: str) -> Column:
        # a repeated entry replaces the one before it
        return F.try_element_at(
            F.filter(results, lambda r: r["datatype"] == name), F.lit(-1)
        )["value"]

    # five numbers per document meet the stations, not the documents
    flat = parsed.select(
        station,
        F.unix_millis(at).alias("timestamp"),
        from_tenths(F.coalesce(reading("TMAX"), reading("TMIN"))).alias("temperature"),
        from_tenths(F.coalesce(reading("PRCP"), F.lit(0.0))).alias("precipitation"),
        F.lit(None).cast("double").alias("humidity"),
        from_tenths(reading("AWND")).alias("wind_speed"),
        F.lit(source).alias("source"),
    )
    rows = flat.join(stations.select(station, "field_id"), station, "left")
    return rows.select(
        station,
        F.coalesce("field_id", F.lit("unknown")).alias("field_id"),
        *[c for c in flat.columns if c != station],
    )
