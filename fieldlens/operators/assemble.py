"""Joining feature tables, dimensions and lookups into training and scoring rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.scalars import (
    encode_map,
    grid_to_latlon,
    iso_week_monday,
    to_number,
    tonnes_to_kg,
)
from fieldlens.operators.weekly import FIELD_WEEK
from fieldlens.schemas import CROP_CODES, DEFAULT_CROP_CODE


def assemble_weekly(
    soil: DataFrame, weather: DataFrame, vegetation: DataFrame, labels: DataFrame
) -> DataFrame:
    """Left joins on (field, week). Every join uses the same keys, so soil is shuffled once."""
    return (
        soil.join(weather, FIELD_WEEK, "left")
        .join(vegetation, FIELD_WEEK, "left")
        .join(labels, FIELD_WEEK, "left")
    )


def enrich(facts: DataFrame, fields: DataFrame, key: str = "field_id") -> DataFrame:
    """Facts with their field's attributes. No broadcast is forced: Spark decides by size."""
    return facts.join(fields, key)


def unknown_fields(facts: DataFrame, fields: DataFrame, key: str = "field_id") -> DataFrame:
    """Facts whose field is not in the dimension."""
    return facts.join(fields, key, "left_anti")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_relaxed(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


# --- season features from wide tables ----------------------------------------------


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "Unnamed" in c or c == "_c0"])


def _numbers(cols: Sequence[str]):
    """Array of the row's usable numbers."""
    cells = F.array(*[to_number(F.col(f"`{c}`")) for c in cols])
    return F.filter(cells, lambda x: x.isNotNull())


def _mean(numbers):
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(numbers))


def season_columns(cols: Sequence[str], first_month: int = 4, last_month: int = 9) -> list[str]:
    """Date columns `Xyyyy.mm.dd` of the growing season."""
    dated = [c for c in cols if c.startswith("X")]
    return [c for c in dated if first_month <= int(c.split(".")[1]) <= last_month]


def climate_season(
    variables: Mapping[str, DataFrame], grid: str = "grid_ID"
) -> DataFrame:
    """Growing-season mean per grid cell and variable (feature name -> wide table).

    The mean of a wide row is taken inside the row; all variables then share one aggregation.
    A cell must occur in every variable's table. Precipitation is a mean as well.
    """
    parts = []
    for name, wide in variables.items():
        wide = drop_unnamed(wide)
        in_season = season_columns([c for c in wide.columns if c != grid])
        parts.append(
            wide.select(
                F.col(grid), F.lit(name).alias("variable"), _mean(_numbers(in_season)).alias("x")
            )
        )
    long = union_all(parts)
    names = list(variables)
    grouped = long.groupBy(grid).agg(
        *[F.avg(F.when(F.col("variable") == v, F.col("x"))).alias(v) for v in names],
        *[F.count_if(F.col("variable") == v).alias(f"_n_{v}") for v in names],
    )
    everywhere = reduce(lambda a, b: a & b, [F.col(f"_n_{v}") > 0 for v in names])
    return grouped.filter(everywhere).select(grid, *names)


def sar_features(wide: DataFrame, year: int, key: str = "ID") -> DataFrame:
    """Mean, range and count of usable values over a year's date columns, per polarisation.

    Columns `Xyyyy…` hold the first ratio, those ending in `.1` the second. Nothing is shuffled.
    """
    dated = [c for c in wide.columns if c.startswith(f"X{year}")]
    families = {
        "ratio": [c for c in dated if not c.endswith(".1")],
        "ratio2": [c for c in dated if c.endswith(".1")],
    }
    outputs = []
    for name, cols in families.items():
        if not cols:
            continue
        numbers = _numbers(cols)
        outputs += [
            _mean(numbers).alias(f"sar_{name}_mean"),
            (F.array_max(numbers) - F.array_min(numbers)).alias(f"sar_{name}_range"),
            F.size(numbers).alias(f"sar_{name}_count"),
        ]
    return wide.select(key, *outputs)


def first_by_key(df: DataFrame, key: str, cols: Sequence[str], order: str) -> DataFrame:
    """First non-null value of each column per key, in the stated order."""
    return df.groupBy(key).agg(
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
            for c in cols
        ]
    )


SOIL_ATTRIBUTES = ["clay", "sand", "silt", "awc", "bd", "fc", "ks", "text"]


def soil_by_grid(soil: DataFrame, order: str, grid: str = "grid_ID") -> DataFrame:
    return first_by_key(drop_unnamed(soil), grid, SOIL_ATTRIBUTES, order)


def one_per_key(df: DataFrame, key: str, cols: Sequence[str], order: str | None = None) -> DataFrame:
    """One whole row per key: the first in `order`, equal ones settled by the smallest values."""
    row = F.struct(*cols)
    rank = row if order is None else F.struct(F.col(order), row)
    return df.groupBy(key).agg(F.min_by(row, rank).alias("_first")).select(key, "_first.*")


# fixed values: what a row gets when its lookup finds nothing
CLIMATE_DEFAULTS = {
    "temperature_2m_mean": 15.0,
    "precipitation_sum": 2.0,
    "shortwave_radiation_sum": 15.0,
    "et0_fao_evapotranspiration": 3.0,
}
DEFAULT_SOIL_CODE = 0
DEFAULT_SOIL_MOISTURE = 0.35
DEFAULT_NDVI = 0.5
DEFAULT_AREA = 50.0
SAR_SCALE = 1000
MID_SEASON_WEEK = 26


def build_training_rows(
    yields: DataFrame,
    sar: DataFrame,
    climate: DataFrame,
    soil: DataFrame,
    year: int,
    crop_codes: Mapping[str, int] = CROP_CODES,
    default_crop: int = DEFAULT_CROP_CODE,
    order: str = "row_order",
) -> DataFrame:
    """Yearly training rows: yields with soil, climate and satellite looked up, gaps defaulted.

    A climate cell that is missing altogether gets the defaults; a cell that is present keeps its
    own nulls. Pass `default_crop=-1` to keep unknown crops apart from the default crop. Each lookup
    gives one row per key, the first by the column named `order` if it has one, so yields keep their
    number of rows.
    """

    def lookup(df: DataFrame, key: str, *cols: str) -> DataFrame:
        return one_per_key(df, key, cols, order if order in df.columns else None)

    lat, lon = grid_to_latlon("east", "north")
    found = lookup(climate, "grid_ID", *CLIMATE_DEFAULTS).withColumn("_climate", F.lit(True))
    joined = (
        yields.join(lookup(soil, "grid_ID", "text", "awc"), "grid_ID", "left")
        .join(found, "grid_ID", "left")
        .join(lookup(sar, "ID", "sar_ratio_mean"), "ID", "left")
    )
    rows = joined.select(
        lat.alias("lat"),
        lon.alias("lon"),
        F.lit(DEFAULT_AREA).alias("area_ha"),
        encode_map("Crop", crop_codes, default_crop).alias("crop_type_encoded"),
        F.coalesce(to_number("text").cast("int"), F.lit(DEFAULT_SOIL_CODE)).alias(
            "soil_type_encoded"
        ),
        F.lit(0).alias("region_encoded"),
        *[
            F.when(F.col("_climate"), F.col(c)).otherwise(F.lit(default)).alias(c)
            for c, default in CLIMATE_DEFAULTS.items()
        ],
        F.coalesce(to_number("awc"), F.lit(DEFAULT_SOIL_MOISTURE)).alias("soil_moisture"),
        F.coalesce(F.col("sar_ratio_mean") / SAR_SCALE, F.lit(DEFAULT_NDVI)).alias("ndvi"),
        F.lit(MID_SEASON_WEEK).alias("week_of_year"),
        F.lit(year).alias("year"),
        tonnes_to_kg("Yield").alias("yield_kg_per_ha"),
        F.col("ID").cast("string").alias("field_id"),
    )
    return rows.withColumn("week_start", iso_week_monday("year", "week_of_year"))
