"""Scene selection for fields by overlapping boxes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.scalars import moment

BOX = ["lon_min", "lat_min", "lon_max", "lat_max"]


def _cells(df: DataFrame, size: float) -> DataFrame:
    """One row per grid cell that the box touches."""

    def span(lo: str, hi: str):
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))

    return df.withColumn("_x", F.explode(span("lon_min", "lon_max"))).withColumn(
        "_y", F.explode(span("lat_min", "lat_max"))
    )


def latest_scene(
    fields: DataFrame,
    scenes: DataFrame,
    as_of: datetime,
    lookback_days: int = 14,
    max_cloud: float = 80.0,
    cell: float = 0.25,
    key: str = "field_id",
) -> DataFrame:
    """Newest scene per field that overlaps its box, is recent and is not too cloudy.

    `fields` and `scenes` carry lon_min, lat_min, lon_max, lat_max; scenes also `scene_id`,
    `datetime` and `cloud_cover`. Before the join the catalogue is thinned without changing the
    answer: of scenes with the same footprint only the newest can win, and of scenes that cover a
    whole grid cell only the newest can win in that cell. What is left meets the fields in an
    equi-join on the cell with an exact overlap test.
    """
    since = as_of - timedelta(days=lookback_days)
    usable = scenes.filter(
        (F.col("datetime") >= moment(since))
        & (F.col("datetime") <= moment(as_of))
        & (F.col("cloud_cover") < max_cloud)
    )
    newest_first = [F.col("datetime").desc(), F.col("scene_id").desc()]

    def newest_per(df: DataFrame, keys: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
        return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")

    footprints = newest_per(usable.select("scene_id", "datetime", "cloud_cover", *BOX), BOX)
    placed = _cells(footprints, cell).withColumn(
        "_covers",
        (F.col("lon_min") <= F.col("_x") * cell)
        & (F.col("lon_max") >= (F.col("_x") + 1) * cell)
        & (F.col("lat_min") <= F.col("_y") * cell)
        & (F.col("lat_max") >= (F.col("_y") + 1) * cell),
    )
    covering = newest_per(placed.filter("_covers"), ["_x", "_y"])
    partial = placed.filter("not _covers")
    candidates = covering.unionByName(partial).select(
        "_x", "_y", "scene_id", "datetime", "cloud_cover", *[F.col(c).alias(f"s_{c}") for c in BOX]
    )
    boxes = _cells(fields.select(key, *BOX), cell)
    overlap = (
        (F.col("lon_min") <= F.col("s_lon_max"))
        & (F.col("lon_max") >= F.col("s_lon_min"))
        & (F.col("lat_min") <= F.col("s_lat_max"))
        & (F.col("lat_max") >= F.col("s_lat_min"))
    )
    hits = boxes.join(candidates, ["_x", "_y"]).filter(overlap)
    return newest_per(hits.select(key, "scene_id", "datetime", "cloud_cover"), [key])
