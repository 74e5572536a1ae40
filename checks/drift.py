"""Population stability, verdicts, retraining, drift reports."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from checks.tables import (
    EVENTS,
    METRICS,
    PREDICTIONS,
    events_with_k,
    load,
    predictions,
    rounded,
    shown,
    ts_sql,
)
from fieldlens.operators.drift import (
    classify_drift,
    drift_level,
    drift_scores,
    psi,
    psi_edges,
    psi_profile,
    retrain_from_psi,
    retrain_from_rmse,
    rolling_buffer,
    seasonal_rmse,
    to_long,
)
from fieldlens.operators.metrics import regression_metrics_by, season_of
from fieldlens.operators.sketches import merged_sketches, profile_of_sketches, weekly_sketches
from fieldlens.operators.reports import category_drift, column_drift, numeric_drift, performance_drift

MIDDLE = "2024-01-16"
BINS = 10


def wide_events(spark, sf):
    k = F.col("k")
    calm = F.when(F.col("event_type") != "error", F.col("value"))
    return events_with_k(spark, sf).select(
        F.col("event_type").alias("field_id"),
        F.concat(F.lit("F"), "user_id").alias("user"),
        "ts",
        "event_id",
        calm.alias("rainfall_today_mm"),
        k.alias("t2m_max_today"),
        (F.col("value") * k / 97).alias("et0_today"),
        (k * 0 + 7).alias("t2m_min_today"),
    )


FEATURES = ["rainfall_today_mm", "t2m_max_today", "et0_today", "t2m_min_today"]


def halves(spark, sf):
    rows = wide_events(spark, sf)
    return rows.filter(F.col("ts") < MIDDLE), rows.filter(F.col("ts") >= MIDDLE)


LONG = f"""{EVENTS}, wide AS (
  SELECT event_type AS field_id, 'F' || user_id AS "user", ts, event_id,
    CASE WHEN event_type <> 'error' THEN value END AS rainfall_today_mm, k AS t2m_max_today,
    value * k / 97 AS et0_today, k * 0 + 7 AS t2m_min_today FROM ev),
  long AS (
  SELECT * FROM (UNPIVOT wide ON rainfall_today_mm, t2m_max_today, et0_today, t2m_min_today
    INTO NAME feature VALUE value)),
  ref AS (SELECT feature, value FROM long WHERE ts < TIMESTAMP '{MIDDLE}'),
  cur AS (SELECT * FROM long WHERE ts >= TIMESTAMP '{MIDDLE}'),
  qs AS (SELECT feature, count(*) AS n_ref,
    list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS q
    FROM ref GROUP BY feature),
  edges AS (SELECT feature, n_ref, list_sort(q) AS e FROM qs)"""


def psi_sql(source: str, keys: str) -> str:
    """PSI of `source` (with `keys` and feature) against ref, unrounded."""
    on = " AND ".join(f"c.{k} = g.{k}" for k in keys.split(", ") if k)
    return f"""bins AS (SELECT feature, n_ref, unnest(range(1, len(e))) AS b, e FROM edges),
  rc AS (SELECT bins.feature, b, count(ref.value) AS n FROM bins LEFT JOIN ref
    ON ref.feature = bins.feature AND ref.value >= e[b]
      AND (ref.value < e[b + 1] OR (b = len(e) - 1 AND ref.value = e[b + 1])) GROUP BY ALL),
  groups AS (SELECT {keys}, count(*) AS n_cur FROM {source} GROUP BY ALL),
  cc AS (SELECT {', '.join('g.' + k for k in keys.split(', '))}, b, n_ref, n_cur,
      count(c.value) AS n
    FROM groups g JOIN bins ON g.feature = bins.feature LEFT JOIN {source} c
      ON {on} AND c.value >= e[b]
      AND (c.value < e[b + 1] OR (b = len(e) - 1 AND c.value = e[b + 1])) GROUP BY ALL),
  sh AS (SELECT cc.*, CASE WHEN rc.n = 0 THEN 1e-4 ELSE rc.n / n_ref END AS r,
    CASE WHEN cc.n = 0 THEN 1e-4 ELSE cc.n / n_cur END AS s
    FROM cc JOIN rc ON cc.feature = rc.feature AND cc.b = rc.b),
  scored AS (SELECT {', '.join('g.' + k for k in keys.split(', '))}, edges.n_ref, g.n_cur,
    CASE WHEN max(edges.n_ref) < 10 OR max(g.n_cur) < 30
      THEN 0 ELSE coalesce(sum((s - r) * ln(s / r)), 0) END AS psi
    FROM groups g JOIN edges ON edges.feature = g.feature LEFT JOIN sh ON {on.replace('c.', 'sh.')}
    GROUP BY ALL)"""


def q_psi_edges(spark, sf):
    ref, _ = halves(spark, sf)
    edges = psi_edges(to_long(ref, [], FEATURES), n_bins=BINS)
    return shown(
        edges.select(
            "feature", F.col("n_values").alias("n_ref"), F.posexplode("edges").alias("i", "edge")
        )
    )


EDGES_SQL = f"""WITH {LONG}
SELECT feature, n_ref, CAST(i AS INTEGER) AS i, round(edge, 6) AS edge FROM (
  SELECT feature, n_ref, unnest(range(len(e))) AS i, unnest(e) AS edge FROM edges)"""


def scores_by_feature(spark, sf):
    ref, cur = halves(spark, sf)
    profile = psi_profile(to_long(ref, [], FEATURES), n_bins=BINS)
    return psi(profile, to_long(cur, [], FEATURES), n_bins=BINS)


def q_psi_by_feature(spark, sf):
    return shown(scores_by_feature(spark, sf))


PSI_SQL = f"""WITH {LONG}, {psi_sql('cur', 'feature')}
SELECT feature, n_ref AS n_reference, n_cur AS n_current, round(psi, 6) AS psi FROM scored"""


def q_sketch_profile(spark, sf):
    """A reference from sketches per week: values seen, and whether scores are those of the exact one."""
    ref, cur = halves(spark, sf)
    weeks = weekly_sketches(to_long(ref, ["ts"], FEATURES))
    found = psi(profile_of_sketches(merged_sketches(weeks)), to_long(cur, [], FEATURES), n_bins=BINS)
    exact = scores_by_feature(spark, sf).select("feature", F.col("psi").alias("exact"))
    near = F.abs(F.col("psi") - F.col("exact")) < 0.02
    return found.join(exact, "feature").select("feature", "n_reference", "n_current", near.alias("near"))


SKETCH_SQL = f"""WITH {LONG}, {psi_sql('cur', 'feature')}
SELECT feature, n_ref AS n_reference, n_cur AS n_current, TRUE AS near FROM scored"""


def q_psi_by_user(spark, sf):
    """One verdict per (user, feature) against the shared reference."""
    ref, cur = halves(spark, sf)
    profile = psi_profile(to_long(ref, [], FEATURES), n_bins=BINS)
    return shown(psi(profile, to_long(cur, ["user"], FEATURES), ["user", "feature"], n_bins=BINS))


PSI_USER_SQL = f"""WITH {LONG}, {psi_sql('cur', '"user", feature')}
SELECT "user", feature, n_ref AS n_reference, n_cur AS n_current, round(psi, 6) AS psi
FROM scored"""


def buffers(spark, sf):
    _, cur = halves(spark, sf)
    return rolling_buffer(to_long(cur, ["field_id", "ts", "event_id"], FEATURES), tie=["event_id"])


def q_drift_level(spark, sf):
    ref, _ = halves(spark, sf)
    profile = psi_profile(to_long(ref, [], FEATURES), n_bins=BINS)
    levels = drift_level(drift_scores(buffers(spark, sf), profile))
    return shown(levels.withColumn("psi_scores", listed("psi_scores")))


def listed(scores):
    """feature=psi in ten-thousandths, by feature."""
    return F.array_join(
        F.transform(
            F.map_entries(scores), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 10_000).cast("long").cast("string"))
        ),
        ",",
    )


BUFFER = """buf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field_id, feature
    ORDER BY ts DESC, event_id DESC) AS rn FROM cur) WHERE rn <= 500)"""

LEVELS = """max(round(psi, 4)) AS m,
    string_agg(feature || '=' || CAST(round(round(psi, 4) * 10000) AS BIGINT), ',' ORDER BY feature) AS psi_scores"""
LEVEL = """round(m, 4) AS max_psi, m > 0.5 AS drift_warning,
  CASE WHEN m > 0.5 THEN 'red' WHEN m > 0.25 THEN 'amber' ELSE 'green' END AS drift_level, psi_scores"""
LEVEL_SQL = f"""WITH {LONG}, {BUFFER}, {psi_sql('buf', 'field_id, feature')},
  f AS (SELECT field_id, {LEVELS} FROM scored GROUP BY field_id)
SELECT field_id, {LEVEL} FROM f"""


def q_retrain_decision(spark, sf):
    ref, cur = halves(spark, sf)
    profile = psi_profile(to_long(ref, [], FEATURES), n_bins=BINS)
    scored = psi(profile, to_long(cur, ["field_id"], FEATURES), ["field_id", "feature"])
    return shown(retrain_from_psi(scored, ["field_id"], threshold=0.01))


RETRAIN_SQL = f"""WITH {LONG}, {psi_sql('cur', 'field_id, feature')}
SELECT field_id, count(*) FILTER (psi > 0.01) AS breached_feature_count,
  count(*) AS total_feature_count,
  round(count(*) FILTER (psi > 0.01) / count(*), 6) AS breach_ratio,
  count(*) FILTER (psi > 0.01) / count(*) > 0.30 AS retrain FROM scored GROUP BY field_id"""


def season_pairs(spark, sf):
    """Every season of every year with the same season of the year before."""
    rows = predictions(spark, sf).withColumns({"name": season_of("ts"), "year": F.year("ts")})
    found = regression_metrics_by(rows, ["name", "year"], "yield_kg_per_ha", "prediction")
    named = lambda year: found.withColumn("season", F.concat_ws("-", year.cast("string"), "name"))
    return seasonal_rmse(named(F.col("year")), named(F.col("year") + 1))


SEASON_CASE = """CASE WHEN month(ts) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(ts) BETWEEN 6 AND 8
    THEN 'Summer' WHEN month(ts) BETWEEN 9 AND 11 THEN 'Autumn' ELSE 'Winter' END"""
SEASON_RMSE = f"""{PREDICTIONS}, s AS (SELECT {SEASON_CASE} AS season, year(ts) AS yr, {METRICS}
    FROM pred GROUP BY ALL),
  paired AS (SELECT c.yr || '-' || c.season AS season, c.rmse AS current_rmse, r.rmse AS reference_rmse
    FROM s c JOIN s r ON c.season = r.season AND c.yr = r.yr + 1)"""


def q_retrain_rmse(spark, sf):
    return shown(retrain_from_rmse(season_pairs(spark, sf), max_loss=0.001))


RMSE_SQL = f"""WITH {SEASON_RMSE}, d AS (
  SELECT *, (current_rmse - reference_rmse) / reference_rmse AS loss FROM paired)
SELECT season, {rounded('current_rmse', 'reference_rmse', 'loss AS degradation_ratio')},
  loss > 0.001 AS retrain FROM d"""


def q_classify_drift(spark, sf):
    """Classes over (supplier) groups, with flags taken from their yearly error figures."""
    rows = predictions(spark, sf).withColumn("year", F.year("ts"))
    by_year = regression_metrics_by(
        rows, ["l_suppkey", "year"], "yield_kg_per_ha", "prediction"
    )
    flags = by_year.groupBy("l_suppkey").agg(
        F.bool_or((F.col("year") == 1996) & (F.col("rmse") > 30000)).alias("rolling_psi_breach"),
        F.bool_or((F.col("year") == 1998) & (F.col("rmse") > 32000)).alias("season_psi_breach"),
        F.bool_or((F.col("year") == 2000) & (F.col("rmse") > 34000)).alias("season_rmse_breach"),
    )
    return classify_drift(flags)


CLASSIFY_SQL = f"""WITH {PREDICTIONS}, m AS (
  SELECT l_suppkey, year(ts) AS yr, {METRICS} FROM pred GROUP BY ALL), f AS (
  SELECT l_suppkey, bool_or(yr = 1996 AND rmse > 30000) AS rolling_psi_breach,
    bool_or(yr = 1998 AND rmse > 32000) AS season_psi_breach,
    bool_or(yr = 2000 AND rmse > 34000) AS season_rmse_breach FROM m GROUP BY l_suppkey)
SELECT *, CASE WHEN season_rmse_breach THEN 'genuine_degradation'
  WHEN season_psi_breach THEN 'seasonal_abnormality'
  WHEN rolling_psi_breach THEN 'short_term_shift_or_expected_seasonality'
  ELSE 'stable' END AS drift_class FROM f"""


def q_rolling_buffer(spark, sf):
    rows = to_long(wide_events(spark, sf), ["user", "ts", "event_id"], FEATURES)
    kept = rolling_buffer(
        rows, 20, ["user", "feature"], tie=["event_id"], ttl=timedelta(hours=30)
    )
    return shown(kept)


BUFFER_SQL = f"""WITH {LONG}, r AS (
  SELECT "user", ts, event_id, feature, value,
    row_number() OVER w AS rn, lead(ts) OVER w AS older
  FROM long WINDOW w AS (PARTITION BY "user", feature ORDER BY ts DESC, event_id DESC)),
  k AS (SELECT *, min(CASE WHEN ts - older > INTERVAL 30 HOUR AND rn < 20 THEN rn END)
    OVER (PARTITION BY "user", feature) AS restart FROM r WHERE rn <= 20)
SELECT "user", {ts_sql('ts')} AS ts, event_id, feature, round(value, 6) AS value FROM k
WHERE restart IS NULL OR rn <= restart"""


# --- reports ---------------------------------------------------------------------------


def q_column_drift_ks(spark, sf):
    ref, cur = halves(spark, sf)
    return shown(numeric_drift(ref, cur, FEATURES).drop("p_value"), 5)


KS_BODY = f"""{LONG}, v AS (
  SELECT feature, value, count(*) FILTER (ts < TIMESTAMP '{MIDDLE}') AS r,
    count(*) FILTER (ts >= TIMESTAMP '{MIDDLE}') AS c FROM long GROUP BY ALL),
  t AS (SELECT *, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER g AS tr,
    sum(c) OVER g AS tc, lead(value) OVER w AS nxt FROM v
    WINDOW w AS (PARTITION BY feature ORDER BY value), g AS (PARTITION BY feature)),
  a AS (SELECT feature, max(tr) AS n_ref, max(tc) AS n_cur, max(abs(cr / tr - cc / tc)) AS ks,
    coalesce(sum((nxt - value) * abs(cr / tr - cc / tc)), 0) AS area,
    sqrt(greatest(sum(r * value * value) / max(tr) - (sum(r * value) / max(tr)) ** 2, 0)) AS std
    FROM t GROUP BY feature)"""
KS_SQL = f"""WITH {KS_BODY}
SELECT feature AS "column", CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur,
  round(ks, 5) AS ks, round(area / greatest(std, 0.001), 5) AS wasserstein,
  area / greatest(std, 0.001) >= 0.1 AS drifted FROM a"""


def q_category_drift(spark, sf):
    rows = load(spark, sf, "events").withColumn(
        "bucket", F.get_json_object("props", "$.k")
    )
    ref, cur = rows.filter(F.col("ts") < MIDDLE), rows.filter(F.col("ts") >= MIDDLE)
    return shown(category_drift(ref, cur, ["event_type", "bucket"]))


CATEGORY_SQL = f"""WITH {EVENTS}, b AS (SELECT event_type,
    regexp_extract(props, '([0-9]+)', 1) AS bucket, ts < TIMESTAMP '{MIDDLE}' AS old
    FROM ev),
  l AS (SELECT 'event_type' AS c, event_type AS v, old FROM b
    UNION ALL SELECT 'bucket', bucket, old FROM b),
  n AS (SELECT c, v, count(*) FILTER (old) AS r, count(*) FILTER (NOT old) AS q FROM l GROUP BY ALL),
  p AS (SELECT c, r, q, sum(r) OVER (PARTITION BY c) AS tr, sum(q) OVER (PARTITION BY c) AS tq FROM n),
  s AS (SELECT *, r / tr AS a, q / tq AS b FROM p)
SELECT c AS "column", CAST(max(tr) AS BIGINT) AS n_ref, CAST(max(tq) AS BIGINT) AS n_cur,
  round(sqrt(sum(CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END) / 2), 6) AS jensen_shannon,
  round(sum((q - a * tq) * (q - a * tq) / (a * tq)) FILTER (a > 0), 6) AS chi_square, count(*) AS n_categories,
  sqrt(sum(CASE WHEN a > 0 THEN a * ln(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / ((a + b) / 2)) ELSE 0 END) / 2) >= 0.1 AS drifted
FROM s GROUP BY c"""


def q_column_drift(spark, sf):
    ref, cur = halves(spark, sf)
    return shown(column_drift(ref, cur, FEATURES, ["field_id"]), 5)


DRIFT_SQL = f"""WITH {KS_BODY}, n AS (SELECT event_type AS v,
    count(*) FILTER (ts < TIMESTAMP '{MIDDLE}') AS r, count(*) FILTER (ts >= TIMESTAMP '{MIDDLE}') AS q
    FROM ev GROUP BY ALL),
  s AS (SELECT r / sum(r) OVER () AS a, q / sum(q) OVER () AS b FROM n),
  u AS (SELECT feature AS "column", 'wasserstein' AS method, area / greatest(std, 0.001) AS score
    FROM a UNION ALL
    SELECT 'field_id', 'jensen_shannon',
      sqrt(sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) / 2) FROM s)
SELECT "column", method, round(score, 5) AS score, score >= 0.1 AS drifted,
  round(avg(CAST(score >= 0.1 AS INTEGER)) OVER (), 5) AS drifted_share,
  avg(CAST(score >= 0.1 AS INTEGER)) OVER () >= 0.5 AS dataset_drift FROM u"""


def q_performance_drift(spark, sf):
    rows = predictions(spark, sf)
    ref, cur = rows.filter(F.year("ts") < 1999), rows.filter(F.year("ts") >= 1999)
    return shown(performance_drift(ref, cur, "yield_kg_per_ha", "prediction"), 5)


PERF_SQL = f"""WITH {PREDICTIONS}
SELECT CASE WHEN year(ts) < 1999 THEN 'reference' ELSE 'current' END AS side, count(*) AS n,
  {rounded('avg(p - y) AS mean_error', 'avg(abs(p - y)) AS mae', 'avg(abs((p - y) / y)) AS mape',
  'sqrt(avg((p - y) * (p - y))) AS rmse',
  '1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2', digits=5)}
FROM pred GROUP BY side"""

QUERIES = {
    "sketch_profile": (q_sketch_profile, SKETCH_SQL),
    "psi_edges": (q_psi_edges, EDGES_SQL),
    "psi_by_feature": (q_psi_by_feature, PSI_SQL),
    "psi_by_user": (q_psi_by_user, PSI_USER_SQL),
    "drift_level": (q_drift_level, LEVEL_SQL),
    "retrain_decision": (q_retrain_decision, RETRAIN_SQL),
    "retrain_rmse": (q_retrain_rmse, RMSE_SQL),
    "classify_drift": (q_classify_drift, CLASSIFY_SQL),
    "rolling_buffer": (q_rolling_buffer, BUFFER_SQL),
    "column_drift_ks": (q_column_drift_ks, KS_SQL),
    "category_drift": (q_category_drift, CATEGORY_SQL),
    "column_drift": (q_column_drift, DRIFT_SQL),
    "performance_drift": (q_performance_drift, PERF_SQL),
}
