"""Data contracts: declared checks, batch verdicts, gates and dead letters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlens.functions.scalars import nan_as_null



@dataclass(frozen=True)
class NotNull:
    col: str
    kind: str = "not_null"

    def checked(self) -> Column:
        return F.lit(True)

    def bad(self) -> Column:
        return F.col(self.col).isNull()

    mostly = 1.0


@dataclass(frozen=True)
class Between:
    """In [lo, hi] for at least `mostly` of the non-null values."""

    col: str
    lo: float
    hi: float
    mostly: float = 1.0
    kind: str = "between"

    def checked(self) -> Column:
        return F.col(self.col).isNotNull()

    def bad(self) -> Column:
        return ~F.col(self.col).between(self.lo, self.hi)


@dataclass(frozen=True)
class InSet:
    col: str
    values: tuple
    mostly: float = 1.0
    kind: str = "in_set"

    def checked(self) -> Column:
        return F.col(self.col).isNotNull()

    def bad(self) -> Column:
        return ~F.col(self.col).isin(*self.values)


@dataclass(frozen=True)
class Increasing:
    """Each value larger than the one before it, within `keys`, in the stated order."""

    col: str
    order: str
    keys: tuple[str, ...] = ()
    kind: str = "increasing"
    mostly = 1.0


# --- fixed values: suites -----------------------------------------------------------
SENSOR_SUITE = [
    NotNull("field_id"),
    NotNull("device_id"),
    NotNull("timestamp"),
    Between("temperature", 0, 50, 0.95),
    Between("moisture", 0, 100, 0.95),
    Between("ph", 4.0, 9.0, 0.98),
    Between("nitrogen", 0, 500, 0.95),
    Between("phosphorus", 0, 200, 0.95),
    Between("potassium", 0, 600, 0.95),
    InSet("fault_mode", ("NONE", "DROPOUT", "DRIFT", "BURST")),
]
WEATHER_SUITE = [
    NotNull("station_id"),
    NotNull("field_id"),
    NotNull("timestamp"),
    Between("temperature", -30, 55, 0.95),
    Between("precipitation", 0, 300, 0.99),
    Between("humidity", 0, 100, 0.97),
    Between("wind_speed", 0, 150, 0.97),
    NotNull("temperature"),
]
NDVI_SUITE = [
    Between("ndvi", -1.0, 1.0, 0.99),
    Between("cloud_cover_pct", 0, 100),
    InSet("ndvi_interpolated", (True, False)),
    InSet("ndvi_proxied", (True, False)),
]
SUITES = {
    "soil-sensors": SENSOR_SUITE,
    "weather-events": WEATHER_SUITE,
    "satellite-ndvi": NDVI_SUITE,
}
INCREASING_KEYS = {"soil-sensors": ("device_id",), "weather-events": ("station_id",)}


def ordered_suite(topic: str, order: str = "received") -> list:
    """The topic's suite with the check that a device's times increase, in the order in which its rows arrived."""
    keys = INCREASING_KEYS.get(topic)
    return [*SUITES[topic], *([Increasing("timestamp", order, keys)] if keys else [])]


# --- fixed values: feature contract (feature, min, max, nullable) ----------------------
FEATURE_CONTRACT = [
    ("rainfall_today_mm", 0.0, 150.0, False),
    ("rainfall_30d_mm", 0.0, 500.0, False),
    ("solar_radiation_today", 0.0, 40.0, True),
    ("t2m_max_today", -20.0, 50.0, False),
    ("t2m_min_today", -25.0, 40.0, False),
    ("rh2m_today", 0.0, 100.0, True),
    ("windspeed_today", 0.0, 60.0, True),
    ("et0_today", 0.0, 20.0, True),
    ("gdd_accumulation", 0.0, 3000.0, False),
    ("ndvi_latest", -1.0, 1.0, True),
    ("ndvi_14d_delta", -1.0, 1.0, True),
]
MAX_NULL_RATE = 0.05


def violations_in_order(
    df: DataFrame, col: str, order: str, keys: Sequence[str] = (), width: float = 86_400.0
) -> DataFrame:
    """Per key: values that follow another one, and those not larger than the one before.

    Equal order values are taken in value order. `order` is a number or a time; `width` (seconds
    for a time) cuts it into stretches so that a key of any length is checked in pieces, and the
    ends of neighbouring stretches are then compared.
    """
    is_time = isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType))
    position = (
        F.unix_micros(F.col(order).cast("timestamp")) / 1_000_000
        if is_time
        else F.col(order).cast("double")
    )
    keys = list(keys)
    rows = df.filter(F.col(col).isNotNull() & F.col(order).isNotNull()).select(
        *keys, F.floor(position / width).alias("_part"), F.col(order).alias("_o"),
        F.col(col).alias("_v"),
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_o", "_v")
    stepped = rows.withColumn("_prev", F.lag("_v").over(inside))
    parts = stepped.groupBy(*keys, "_part").agg(
        F.count("_prev").alias("_pairs"),
        F.count_if(F.col("_v") <= F.col("_prev")).alias("_bad"),
        F.min(F.struct("_o", "_v")).alias("_first"),
        F.max(F.struct("_o", "_v")).alias("_last"),
    )
    # one row per stretch
    along = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part")
    joined = parts.withColumn("_left", F.lag("_last").over(along))
    seam = F.col("_left").isNotNull()
    seam_bad = seam & (F.col("_first._v") <= F.col("_left._v"))
    return joined.groupBy(*keys).agg(
        (F.sum("_pairs") + F.count_if(seam)).alias("n_checked"),
        (F.sum("_bad") + F.count_if(seam_bad)).alias("n_bad"),
    )


def strictly_increasing(
    df: DataFrame, col: str, order: str, keys: Sequence[str] = (), width: float = 86_400.0
) -> DataFrame:
    checked = violations_in_order(df, col, order, keys, width)
    return checked.withColumn("increasing", F.col("n_bad") == 0)




def _report_rows(suite: Sequence) -> Column:
    """The counts `_n0`, `_b0`, … of a suite's checks as report rows."""
    return F.array(
        *[
            F.struct(
                F.lit(c.kind).alias("check"),
                F.lit(c.col).alias("column"),
                F.col(f"_n{i}").alias("n_checked"),
                F.col(f"_b{i}").alias("n_bad"),
                F.lit(float(c.mostly)).alias("mostly"),
            )
            for i, c in enumerate(suite)
        ]
    )


def _judged(report: DataFrame) -> DataFrame:
    good = F.try_divide(F.col("n_checked") - F.col("n_bad"), F.col("n_checked"))
    return report.withColumn("share_ok", F.coalesce(good, F.lit(1.0))).withColumn(
        "success", F.col("share_ok") >= F.col("mostly")
    )


def validate(df: DataFrame, suite: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """One report row per check (and `keys`). All plain checks share a single aggregation."""
    keys = list(keys)
    plain = [c for c in suite if not isinstance(c, Increasing)]
    counted = df.groupBy(*keys).agg(
        *[F.count_if(c.checked()).alias(f"_n{i}") for i, c in enumerate(plain)],
        *[F.count_if(c.checked() & c.bad()).alias(f"_b{i}") for i, c in enumerate(plain)],
    )
    report = counted.select(*keys, F.inline(_report_rows(plain)))
    for c in suite:
        if isinstance(c, Increasing):
            found = violations_in_order(df, c.col, c.order, [*keys, *c.keys])
            total = found.groupBy(*keys).agg(
                F.coalesce(F.sum("n_checked"), F.lit(0)).alias("n_checked"),
                F.coalesce(F.sum("n_bad"), F.lit(0)).alias("n_bad"),
            )
            report = report.unionByName(
                total.select(
                    *keys,
                    F.lit(c.kind).alias("check"),
                    F.lit(c.col).alias("column"),
                    "n_checked",
                    "n_bad",
                    F.lit(1.0).alias("mostly"),
                )
            )
    return _judged(report)


# --- contracts across batches ----------------------------------------------------------


def contract_state(df: DataFrame, suite: Sequence, keys: Sequence[str]) -> DataFrame:
    """What a batch adds to the checks of each of `keys`, which name a window and a device.

    Counts per check; for an increasing column also its first and last value, in its order, so that batches that arrive
    one after the other can be joined. `keys` hold the keys of the increasing checks.
    """
    keys, out = list(keys), []
    for i, c in enumerate(suite):
        if isinstance(c, Increasing):
            known = F.col(c.col).isNotNull() & F.col(c.order).isNotNull()
            item = F.when(known, F.struct(F.col(c.order).alias("o"), F.col(c.col).alias("v")))
            inside = Window.partitionBy(*keys).orderBy(item.isNull(), item)
            before = F.when(known, F.lag(item).over(inside))
            df = df.withColumn(f"_v{i}", item).withColumn(f"_l{i}", before)
            pair = F.col(f"_l{i}").isNotNull()
            bad = pair & (F.col(f"_v{i}.v") <= F.col(f"_l{i}.v"))
            out += [F.count_if(pair).alias(f"_n{i}"), F.count_if(bad).alias(f"_b{i}")]
            out += [F.min(f"_v{i}").alias(f"_f{i}"), F.max(f"_v{i}").alias(f"_t{i}")]
        else:
            out += [F.count_if(c.checked()).alias(f"_n{i}"), F.count_if(c.checked() & c.bad()).alias(f"_b{i}")]
    return df.groupBy(*keys).agg(*out)


def merged_states(kept: DataFrame, batch: DataFrame, suite: Sequence, keys: Sequence[str]) -> DataFrame:
    """The state after a batch. There are two rows per key at most, the kept one and the batch's."""
    keys, out = list(keys), []
    rows = kept.unionByName(batch)
    for i, c in enumerate(suite):
        if isinstance(c, Increasing):
            along = Window.partitionBy(*keys).orderBy(F.col(f"_f{i}").isNull(), f"_f{i}")
            rows = rows.withColumn(f"_l{i}", F.when(F.col(f"_f{i}").isNotNull(), F.lag(f"_t{i}").over(along)))
            seam = F.col(f"_l{i}").isNotNull()
            bad = seam & (F.col(f"_f{i}.v") <= F.col(f"_l{i}.v"))
            out += [(F.sum(f"_n{i}") + F.count_if(seam)).alias(f"_n{i}"), (F.sum(f"_b{i}") + F.count_if(bad)).alias(f"_b{i}")]
            out += [F.min(f"_f{i}").alias(f"_f{i}"), F.max(f"_t{i}").alias(f"_t{i}")]
        else:
            out += [F.sum(f"_n{i}").alias(f"_n{i}"), F.sum(f"_b{i}").alias(f"_b{i}")]
    return rows.groupBy(*keys).agg(*out)


def state_report(state: DataFrame, suite: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """The report of `validate` from states; `keys` name the window, devices are added up."""
    sums = state.groupBy(*keys).agg(
        *[F.sum(f"_{x}{i}").alias(f"_{x}{i}") for i in range(len(suite)) for x in ("n", "b")]
    )
    return _judged(sums.select(*keys, F.inline(_report_rows(suite))))


def verdict(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return report.groupBy(*keys).agg(
        F.bool_and("success").alias("valid"), F.count_if(~F.col("success")).alias("n_failed")
    )


def row_ok(suite: Sequence) -> Column:
    """Row-level form of the plain checks, for quarantining single rows."""
    ok = F.lit(True)
    for c in suite:
        if not isinstance(c, Increasing):
            ok = ok & ~F.coalesce(c.checked() & c.bad(), F.lit(False))
    return ok


def split_rows(df: DataFrame, suite: Sequence) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows."""
    ok = row_ok(suite)
    return df.filter(ok), df.filter(~ok)


def check_contract(
    df: DataFrame,
    contract: Sequence[tuple[str, float, float, bool]] = tuple(FEATURE_CONTRACT),
    max_null_rate: float = MAX_NULL_RATE,
) -> DataFrame:
    """One row per contracted feature: type, range and null rate, from one aggregation."""
    types = dict(df.dtypes)
    present = [c for c in contract if c[0] in types]
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(name)).alias(f"_n_{name}") for name, *_ in present],
        *[
            F.count_if(~F.col(name).try_cast("double").between(lo, hi)).alias(f"_bad_{name}")
            for name, lo, hi, _ in present
        ],
    )
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.lit(name in types).alias("present"),
                F.lit(types.get(name, "").startswith(numeric)).alias("type_ok"),
                F.lit(nullable).alias("nullable"),
                (
                    F.try_divide(F.col("_rows") - F.col(f"_n_{name}"), F.col("_rows"))
                    if name in types
                    else F.lit(None).cast("double")
                ).alias("null_rate"),
                (
                    F.col(f"_bad_{name}") if name in types else F.lit(None).cast("bigint")
                ).alias("n_out_of_range"),
            )
            for name, _, _, nullable in contract
        ]
    )
    nulls_ok = F.col("nullable") | (F.coalesce("null_rate", F.lit(0.0)) <= max_null_rate)
    return counted.select(F.inline(rows)).withColumn(
        "success",
        F.col("present") & F.col("type_ok") & nulls_ok
        & (F.coalesce("n_out_of_range", F.lit(0)) == 0),
    )


# fixed values: columns the daily climate gate looks at
GATE_COLS = ["PRECTOTCORR", "T2M_MAX", "T2M_MIN", "RH2M"]


def climate_gate(daily: DataFrame, key: str = "field_id") -> DataFrame:
    """Verdict per field: null rates, temperature range, no negative rain. NaN counts as null."""
    daily = nan_as_null(daily, GATE_COLS)
    hot = F.coalesce((F.col("T2M_MAX") < -20) | (F.col("T2M_MAX") > 50), F.lit(False))
    wet = F.coalesce(F.col("PRECTOTCORR") < 0, F.lit(False))
    checked = daily.groupBy(key).agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in GATE_COLS],
        F.bool_or(hot).alias("temperature_out_of_range"),
        F.bool_or(wet).alias("negative_rain"),
    )
    worst = F.greatest(*[F.col(f"null_{c}") for c in GATE_COLS])
    return checked.select(
        key,
        worst.alias("max_null_rate"),
        "temperature_out_of_range",
        "negative_rain",
        (
            (worst <= MAX_NULL_RATE)
            & ~F.col("temperature_out_of_range")
            & ~F.col("negative_rain")
        ).alias("passed"),
    )


def gated(daily: DataFrame, key: str = "field_id") -> DataFrame:
    """Daily rows of the fields that pass the gate."""
    passed = climate_gate(daily, key).filter("passed").select(key)
    return daily.join(passed, key, "left_semi")


def parse_json(
    raw: DataFrame, schema: T.StructType, required: Sequence[str], value: str = "value"
) -> DataFrame:
    """Adds `_row` (parsed) and `_error` (null when usable) to raw JSON text."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # a generated column is computed once, whatever is selected or filtered from it afterwards
    once = F.explode(F.array(F.from_json(value, wide, options)))
    parsed = raw.select("*", once.alias("_row"))
    problem = F.when(
        F.col("_row").isNull() | F.col("_row._corrupt_record").isNotNull(), "malformed_json"
    )
    for c in required:
        problem = problem.when(F.col(f"_row.{c}").isNull(), f"missing_{c}")
    return parsed.withColumn("_error", problem)


def usable(parsed: DataFrame, schema: T.StructType, carried: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows of `parse_json` without an error, with further columns of the message if asked for."""
    more = [column.alias(name) for name, column in (carried or {}).items()]
    return parsed.filter("_error is null").select(
        *[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields], *more
    )


def unusable(parsed: DataFrame, at: Column, value: str = "value", key: str = "key") -> DataFrame:
    """Dead letters: key, error, epoch-ms time and the original text."""
    return parsed.filter("_error is not null").select(
        F.col(key).alias("key"),
        F.col("_error").alias("error"),
        F.unix_millis(at).alias("timestamp"),
        F.col(value).alias("value"),
    )


def dead_letter(
    raw: DataFrame,
    schema: T.StructType,
    required: Sequence[str],
    at: Column,
    value: str = "value",
    key: str = "key",
) -> tuple[DataFrame, DataFrame]:
    """(usable rows, dead letters). Both read the messages; a job that needs both keeps `parse_json` of them."""
    parsed = parse_json(raw, schema, required, value)
    return usable(parsed, schema), unusable(parsed, at, value, key)


REQUIRED: Mapping[str, Sequence[str]] = {
    "soil-sensors": ["field_id", "device_id", "timestamp"],
    "weather-events": ["station_id", "field_id", "timestamp"],
    "satellite-ndvi": ["field_id", "scene_id", "timestamp"],
}
