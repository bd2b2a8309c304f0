"""Plain SQL for the check tables, built from definitions rather than from the plans.

Intervals are cut by overlap, lookups are ASOF joins and self joins, so that a
mistake in the chunked plans cannot repeat itself here.
"""

import re

from hearthlog.schema import HORIZONS_H

S = 1_800_000_000

EVENTS = f"""
ev AS (
  SELECT user_id // 3 AS household_id, 'u' || user_id AS subject, user_id,
         epoch_us(ts) AS ts_us, event_id AS seq, event_type, value AS reading,
         CASE WHEN event_type IN ('view', 'click') THEN 'home' WHEN event_type = 'signup' THEN 'Office'
              WHEN event_type = 'purchase' THEN 'not_home' ELSE 'unknown' END AS state,
         CASE WHEN event_type = 'error' THEN NULL ELSE round_even(value * 100, 1) END AS metres
  FROM events),
bounds AS (SELECT household_id, (min(ts_us) + {S - 1}) // {S} AS lo, max(ts_us) // {S} AS hi FROM ev GROUP BY ALL),
people AS (SELECT DISTINCT household_id, subject FROM ev),
subjects AS (SELECT * FROM people UNION ALL SELECT DISTINCT household_id, 'house' FROM people),
hgrid AS (SELECT household_id, unnest(range(lo, hi + 1)) AS slot FROM bounds),
grid AS (SELECT household_id, subject, slot FROM subjects JOIN hgrid USING (household_id))"""

HOUSE = """
house_at AS (
  SELECT q.household_id, q.ts_us, bool_or(e.state = 'home') AS any_home, bool_or(e.state = 'unknown') AS any_lost
  FROM (SELECT i.household_id, i.ts_us, p.subject
        FROM (SELECT DISTINCT household_id, ts_us FROM ev) i JOIN people p USING (household_id)) q
  ASOF JOIN ev e ON q.household_id = e.household_id AND q.subject = e.subject AND q.ts_us >= e.ts_us
  GROUP BY ALL),
house_ev AS (
  SELECT household_id, 'house' AS subject, ts_us, CASE WHEN any_home THEN 'home' WHEN any_lost THEN 'unknown' ELSE 'not_home' END AS state
  FROM house_at),
pres AS (SELECT household_id, subject, ts_us, seq, state FROM ev
         UNION ALL SELECT household_id, subject, ts_us, 0, state FROM house_ev)"""

FRACTIONS = f"""
iv AS (SELECT household_id, subject, state, ts_us AS a,
              coalesce(lead(ts_us) OVER (PARTITION BY household_id, subject ORDER BY ts_us, seq), (hi + 1) * {S}) AS b
       FROM pres JOIN bounds USING (household_id)),
cut AS (SELECT household_id, subject, state, a, b, unnest(range(a // {S}, (b - 1) // {S} + 1)) AS slot FROM iv WHERE b > a),
share AS (SELECT household_id, subject, slot, state, least(b, (slot + 1) * {S}) - greatest(a, slot * {S}) AS us FROM cut),
sums AS (
  SELECT household_id, subject, slot,
         sum(us) FILTER (state <> 'unknown') AS obs, coalesce(sum(us) FILTER (state = 'home'), 0) AS home,
         coalesce(sum(us) FILTER (state = 'Office'), 0) AS office, coalesce(sum(us) FILTER (state = 'not_home'), 0) AS other,
         sum(us) AS held, coalesce(sum(us) FILTER (state IN ('not_home', 'unknown')), 0) AS other_or_lost
  FROM share GROUP BY ALL),
frac AS MATERIALIZED (
  SELECT g.household_id, g.subject, g.slot, coalesce(obs, 0) / {S}.0 AS coverage,
         CASE WHEN obs >= {S} * 0.5 THEN home / obs END AS home_frac,
         CASE WHEN obs >= {S} * 0.5 THEN office / obs END AS zone_office,
         CASE WHEN obs >= {S} * 0.5 THEN other / obs END AS zone_other,
         CASE WHEN held >= {S} * 0.5 THEN office / held END AS zone_office_q,
         CASE WHEN held >= {S} * 0.5 THEN other_or_lost / held END AS zone_other_q
  FROM grid g LEFT JOIN sums s USING (household_id, subject, slot)),
turns AS (SELECT household_id, subject, ts_us FROM (
            SELECT *, lag(state) OVER (PARTITION BY household_id, subject ORDER BY ts_us, seq) AS was FROM pres)
          WHERE was IS DISTINCT FROM state),
held AS (SELECT g.household_id, g.subject, g.slot, (g.slot * {S} - t.ts_us) / 6e7 AS minutes
         FROM grid g ASOF LEFT JOIN turns t
           ON g.household_id = t.household_id AND g.subject = t.subject AND g.slot * {S} >= t.ts_us)"""

LIVE = f"""
live AS (SELECT DISTINCT household_id, ts_us FROM ev),
seen AS (
  SELECT p.household_id, p.slot, coalesce(n.ts_us - p.before_us <= 12 * 3600 * 1000000::BIGINT, false) AS observable
  FROM (SELECT g.household_id, g.slot, l.ts_us AS before_us FROM hgrid g ASOF LEFT JOIN live l
          ON g.household_id = l.household_id AND g.slot * {S} >= l.ts_us) p
  ASOF LEFT JOIN live n ON p.household_id = n.household_id AND p.slot * {S} < n.ts_us)"""

PROXIMITY = f"""
km AS MATERIALIZED (
  SELECT g.household_id, g.subject, g.slot, d.metres / 1000 AS distance_km
  FROM grid g ASOF LEFT JOIN (SELECT * FROM ev WHERE metres IS NOT NULL) d
    ON g.household_id = d.household_id AND g.subject = d.subject AND g.slot * {S} >= d.ts_us),
way_iv AS (SELECT household_id, subject, ts_us AS a,
                  CASE event_type WHEN 'view' THEN 'towards' WHEN 'purchase' THEN 'away_from' WHEN 'error' THEN NULL ELSE 'stationary' END AS way,
                  coalesce(lead(ts_us) OVER (PARTITION BY subject ORDER BY ts_us, seq), (hi + 1) * {S}) AS b
           FROM ev JOIN bounds USING (household_id) WHERE user_id % 3 = 0),
way AS MATERIALIZED (SELECT household_id, subject, slot,
               CASE WHEN sum(us) FILTER (way IS NOT NULL) >= {S} * 0.5 THEN coalesce(sum(us) FILTER (way = 'towards'), 0) / sum(us) FILTER (way IS NOT NULL) END AS towards,
               CASE WHEN sum(us) FILTER (way IS NOT NULL) >= {S} * 0.5 THEN coalesce(sum(us) FILTER (way = 'away_from'), 0) / sum(us) FILTER (way IS NOT NULL) END AS away
        FROM (SELECT household_id, subject, slot, way, least(b, (slot + 1) * {S}) - greatest(a, slot * {S}) AS us
              FROM (SELECT *, unnest(range(a // {S}, (b - 1) // {S} + 1)) AS slot FROM way_iv WHERE b > a)) GROUP BY ALL),
prox AS MATERIALIZED (
  SELECT k.household_id, k.subject, k.slot, k.distance_km,
         k.distance_km - km1 AS distance_delta_30m, k.distance_km - km2 AS distance_delta_60m,
         CASE WHEN k.subject <> 'house' AND k.n % 3 = 0 THEN w.towards
              ELSE CAST(k.distance_km - km1 < -0.05 AS DOUBLE) END AS dir_towards,
         CASE WHEN k.subject <> 'house' AND k.n % 3 = 0 THEN w.away
              ELSE CAST(k.distance_km - km1 > 0.05 AS DOUBLE) END AS dir_away
  FROM (SELECT *, try_cast(substr(subject, 2) AS INT) AS n, lag(distance_km) OVER w AS km1, lag(distance_km, 2) OVER w AS km2
        FROM km WINDOW w AS (PARTITION BY household_id, subject ORDER BY slot)) k
  LEFT JOIN way w ON w.subject = k.subject AND w.household_id = k.household_id AND w.slot = k.slot),
alarms AS (
  SELECT household_id, subject, ts_us,
         CASE WHEN event_type = 'purchase' THEN epoch_us(date_trunc('day', make_timestamp(ts_us)) + INTERVAL 31 HOUR) END AS alarm_us
  FROM ev WHERE event_type IN ('purchase', 'signup')),
next_alarm AS (
  SELECT g.household_id, g.subject, g.slot,
         CASE WHEN a.alarm_us > g.slot * {S} THEN (a.alarm_us - g.slot * {S}) / 3.6e9 END AS next_alarm_h
  FROM grid g ASOF LEFT JOIN alarms a ON g.household_id = a.household_id AND g.subject = a.subject AND g.slot * {S} >= a.ts_us)"""

# One row per (subject, slot), blanked where nobody was watching.
ORIGINS = """
blank AS MATERIALIZED (
  SELECT f.household_id, f.subject, f.slot, observable,
         CASE WHEN observable THEN coverage ELSE 0 END AS coverage,
         CASE WHEN observable THEN home_frac END AS home_frac,
         CASE WHEN observable THEN minutes END AS minutes_in_state,
         CASE WHEN observable AND f.subject <> 'house' THEN zone_office END AS z_office,
         CASE WHEN observable AND f.subject <> 'house' THEN zone_other END AS z_other
  FROM frac f JOIN seen USING (household_id, slot) JOIN held USING (household_id, subject, slot)),
origins AS MATERIALIZED (
  SELECT household_id, subject, slot, observable, coverage, home_frac, minutes_in_state,
         CASE WHEN subject = 'house' THEN max(z_office) OVER w ELSE z_office END AS zone_office,
         CASE WHEN subject = 'house' THEN max(z_other) OVER w ELSE z_other END AS zone_other,
         make_timestamp(slot * 1800000000) AS at_ts,
         CAST(extract(hour FROM make_timestamp(slot * 1800000000)) * 2 + extract(minute FROM make_timestamp(slot * 1800000000)) // 30 AS BIGINT) AS sod,
         CAST(isodow(make_timestamp(slot * 1800000000)) - 1 AS BIGINT) AS dow
  FROM blank WINDOW w AS (PARTITION BY household_id, slot))"""

PRESENCE = [EVENTS, HOUSE, FRACTIONS]
ALL_ORIGINS = [EVENTS, HOUSE, FRACTIONS, LIVE, ORIGINS]


def sql(ctes: list[str], select: str) -> str:
    """A nudge keeps exact halves from rounding one way here and another there."""
    text = "WITH " + ",".join(ctes) + "\n" + select
    return re.sub(r"\bround\(", "round(1e-9 + ", text)


# All of them; the bench asks for fewer.
HORIZONS = HORIZONS_H

TARGETS = """
tg AS (SELECT household_id, subject, unnest(range(lo, hi + 97)) AS t FROM subjects JOIN bounds USING (household_id)),
wk AS MATERIALIZED (
  SELECT g.household_id, g.subject, g.t,
         avg(b.home_frac) FILTER (s = 0 AND w <= 4) AS wclim4, avg(b.home_frac) FILTER (s = 0) AS wclim8,
         avg(b.home_frac) FILTER (s = 0 AND w <= 2) AS wclim2,
         avg(b.home_frac) FILTER (s = -2 AND w <= 4) AS back4, avg(b.home_frac) FILTER (s = 2 AND w <= 4) AS fwd4
  FROM tg g CROSS JOIN range(1, 9) w(w) CROSS JOIN (VALUES (-2), (0), (2)) s(s)
  LEFT JOIN blank b ON b.household_id = g.household_id AND b.subject = g.subject AND b.slot = g.t + s - 336 * w
  GROUP BY ALL),
dy AS MATERIALIZED (
  SELECT g.household_id, g.subject, g.t,
         avg(b.home_frac) FILTER (k <= 14) AS sclim_1, avg(b.home_frac) FILTER (k BETWEEN 2 AND 14) AS sclim_2, max(b.home_frac) FILTER (k = 1) AS lag1d, max(b.home_frac) FILTER (k = 2) AS lag2d, max(b.home_frac) FILTER (k = 3) AS lag3d, max(b.home_frac) FILTER (k = 7) AS lag7d, max(b.home_frac) FILTER (k = 14) AS lag14d, max(b.home_frac) FILTER (k = 21) AS lag21d
  FROM tg g CROSS JOIN (SELECT unnest(range(1, 15)) AS k UNION ALL SELECT 21) k
  LEFT JOIN blank b ON b.household_id = g.household_id AND b.subject = g.subject AND b.slot = g.t - 48 * k
  GROUP BY ALL),
smp AS MATERIALIZED (
  SELECT o.household_id, o.subject, o.slot, h AS horizon_h, o.slot + 2 * h AS t, y.home_frac AS y,
         o.home_frac AS state_now, o.coverage,
         CASE WHEN h <= 24 THEN lag1d END AS lag1d, lag2d, lag3d, lag7d, lag14d, lag21d,
         wclim2, wclim4, wclim8, wclim4 - back4 AS slope_back, fwd4 - wclim4 AS slope_fwd,
         CASE WHEN h <= 24 THEN sclim_1 ELSE sclim_2 END AS sclim14,
         CASE WHEN h <= 24 THEN lag1d ELSE lag2d END AS near_lag,
         CAST((o.slot + 2 * h) % 48 AS BIGINT) AS sod, CAST((((o.slot + 2 * h) // 48) + 3) % 7 AS BIGINT) AS dow
  FROM blank o CROSS JOIN (SELECT CAST(unnest(range(1, 49)) AS INTEGER) AS h) h
  LEFT JOIN blank y ON y.household_id = o.household_id AND y.subject = o.subject AND y.slot = o.slot + 2 * h
  JOIN wk ON wk.household_id = o.household_id AND wk.subject = o.subject AND wk.t = o.slot + 2 * h
  JOIN dy ON dy.household_id = o.household_id AND dy.subject = o.subject AND dy.t = o.slot + 2 * h)"""

SAMPLES = ALL_ORIGINS + [TARGETS]
