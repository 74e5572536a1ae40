"""Agronomic column rules: soil proxies, rule-based yield, vegetation index."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.scalars import as_column, clip
from fieldlens.schemas import BASE_YIELD

# fixed values: soil and vegetation placeholders used where no sensor reports
SOIL_TEMPERATURE_SHARE = 0.85
MOISTURE_SPREAD_SHARE = 0.1
PROXY_CONSTANTS = {
    "ph_mean": 6.5,
    "nitrogen_mean": 180.0,
    "phosphorus_mean": 30.0,
    "potassium_mean": 200.0,
    "latest_ndvi": 0.6,
    "cloud_cover_pct": 40.0,
    "ndvi_interpolated": 0,
    "ndvi_proxied": 1,
}


def soil_proxies(weekly: DataFrame) -> DataFrame:
    """Soil columns estimated from weekly weather, plus vegetation placeholders."""
    moisture = clip(F.col("precip_total") / 7, 0, 100)
    return weekly.withColumns(
        {
            "soil_temp_mean": F.col("air_temp_mean") * SOIL_TEMPERATURE_SHARE,
            "soil_temp_std": F.coalesce(F.col("air_temp_std"), F.lit(0.0)) * SOIL_TEMPERATURE_SHARE,
            "moisture_mean": moisture,
            "moisture_std": moisture * MOISTURE_SPREAD_SHARE,
            **{name: F.lit(value) for name, value in PROXY_CONSTANTS.items()},
        }
    )


def expected_yield(
    weekly: DataFrame,
    base_yield: Mapping[str, int] = BASE_YIELD,
    crop: str = "crop_type",
    out: str = "expected_yield_kg_per_ha",
) -> DataFrame:
    """Yield by rule: crop base shifted by limited temperature and rain effects, then clamped."""
    pairs = [F.lit(part) for name, kg in base_yield.items() for part in (name, float(kg))]
    base = F.try_element_at(F.create_map(*pairs), F.col(crop))
    warmth = clip(F.col("air_temp_mean") - 10, -5, 15) * (base * 0.005)
    rain = clip(F.col("precip_total") - 15, -10, 20) * (base * 0.002)
    return weekly.withColumn(out, clip(base + warmth + rain, base * 0.4, base * 1.6))


def ndvi(red: Column | str, nir: Column | str) -> Column:
    """(nir - red) / (nir + red); a zero sum gives null."""
    r, n = as_column(red).cast("double"), as_column(nir).cast("double")
    return F.try_divide(n - r, n + r)


def scene_ndvi(pixels: DataFrame, scene: str = "scene_id", red: str = "red", nir: str = "nir"):
    """Mean index per scene over pixel rows, missing pixels ignored, 4 decimals."""
    return pixels.groupBy(scene).agg(F.round(F.avg(ndvi(red, nir)), 4).alias("ndvi"))


def scene_ndvi_tiles(
    tiles: DataFrame, scene: str = "scene_id", red: str = "red", nir: str = "nir"
) -> DataFrame:
    """The same over tiles that hold two equally long band arrays.

    Each tile is reduced in place to (sum, count), so pixels are never exploded or shuffled.
    """
    values = F.filter(F.zip_with(red, nir, ndvi), lambda x: x.isNotNull())
    reduced = tiles.select(
        scene,
        F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x).alias("s"),
        F.size(values).alias("n"),
    )
    mean = F.try_divide(F.sum("s"), F.sum("n"))
    return reduced.groupBy(scene).agg(F.round(mean, 4).alias("ndvi"))
