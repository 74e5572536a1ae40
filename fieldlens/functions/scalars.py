"""Column expressions. All of them are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.schemas import FEATURE_COLS, KEY_COLS, TARGET


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def moment(at: datetime) -> Column:
    """Timestamp literal read in the session time zone, whatever the driver's own zone is."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


def event_time(epoch_ms: Column | str) -> Column:
    """Epoch milliseconds to timestamp."""
    return F.timestamp_millis(as_column(epoch_ms))


def week_start(ts: Column | str) -> Column:
    """Monday 00:00 of the week that holds `ts`."""
    return F.date_trunc("week", as_column(ts))


def iso_week_monday(year: Column | str, week: Column | str) -> Column:
    """Monday of an ISO (year, week); null when that ISO week does not exist."""
    y, w = as_column(year).cast("int"), as_column(week).cast("int")
    usable = y.between(1, 9998) & w.between(1, 53)
    first_monday = F.date_trunc(
        "week", F.make_date(F.when(usable, y).otherwise(F.lit(1970)), F.lit(1), F.lit(4))
    ).cast("date")
    monday = F.date_add(first_monday, (F.when(usable, w).otherwise(F.lit(1)) - 1) * 7)
    return F.when(usable & (F.weekofyear(monday) == w), monday.cast("timestamp"))


def missing_as_null(col: Column | str) -> Column:
    """NaN counts as missing."""
    c = as_column(col)
    return F.when(~F.isnan(c), c)


def nan_as_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """The same rows with NaN turned into null in those of `cols` that hold floating-point numbers."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: missing_as_null(c) for c in cols if kinds.get(c) in ("double", "float")})


def null_sentinel(df: DataFrame, cols: Iterable[str], sentinel: float = -999.0) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in cols})


def clip(col: Column | str, lo: float | Column, hi: float | Column) -> Column:
    """Limit to [lo, hi]; null stays null."""
    c = as_column(col)
    low = lo if isinstance(lo, Column) else F.lit(float(lo))
    high = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def to_number(col: Column | str) -> Column:
    """Text or number to double; anything else, and NaN, becomes null."""
    return missing_as_null(as_column(col).try_cast("double"))


def numbers_or_zero(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(to_number(c), F.lit(0.0)) for c in cols})


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def flag_to_int(col: Column | str) -> Column:
    return as_column(col).cast("int")


def encode_map(col: Column | str, codes: Mapping[str, int], default: int) -> Column:
    """Code of a category from a fixed table; unknown and null get `default`."""
    pairs = [F.lit(part) for item in codes.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_column(col)), F.lit(default))


def encode_sorted(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Code labels by their alphabetical position; null stays null.

    The distinct labels are ranked, a row each, and joined back: Spark broadcasts them if they are small.
    """
    out = out or f"{col}_encoded"
    labels = df.select(F.col(col).alias("_label")).filter("_label is not null").distinct()
    place = (F.row_number().over(Window.orderBy("_label")) - 1).cast("int")
    coded = df.drop(out).join(labels.withColumn(out, place), F.col(col) == F.col("_label"), "left")
    return coded.select(*[c for c in df.columns if c != out], out)


# fixed values: constants of the linear grid approximation
GRID_ORIGIN = (400000, 100000)
GRID_ANCHOR = (52.5, -1.5)
METRES_PER_DEGREE = 111320


def grid_to_latlon(east: Column | str, north: Column | str) -> tuple[Column, Column]:
    """Linear approximation of latitude and longitude from grid metres, 5 decimals."""
    e = as_column(east).cast("double") - GRID_ORIGIN[0]
    n = as_column(north).cast("double") - GRID_ORIGIN[1]
    lat = F.lit(GRID_ANCHOR[0]) + n / METRES_PER_DEGREE / 1000
    lon = F.lit(GRID_ANCHOR[1]) + e / (METRES_PER_DEGREE * F.cos(F.radians(lat))) / 1000
    return F.round(lat, 5), F.round(lon, 5)


def from_tenths(col: Column | str) -> Column:
    return as_column(col) / 10


def tonnes_to_kg(col: Column | str) -> Column:
    return as_column(col).cast("double") * 1000


def align_features(
    df: DataFrame, features: Iterable[str] = FEATURE_COLS, keep: Iterable[str] = ()
) -> DataFrame:
    """The model's ordered numeric columns; absent, non-numeric or missing values become 0."""
    have = set(df.columns)
    aligned = [
        (F.coalesce(to_number(c), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
        for c in features
    ]
    return df.select(*[F.col(c) for c in keep], *aligned)


def feature_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEY_COLS]


def drop_unlabelled(df: DataFrame, cols: Iterable[str] = (TARGET,)) -> DataFrame:
    return df.dropna(subset=list(cols))


def round_doubles(df: DataFrame, digits: int) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in doubles})
