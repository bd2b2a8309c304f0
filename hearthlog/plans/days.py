"""Day labels, causal windows and routines over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlog.operators import days as d
from hearthlog.operators.ladder import best_weight, moments
from hearthlog.plans import build
from hearthlog.plans.features import ROLES, SQL_ROLE, role
from hearthlog.plans.grid import rnd, rounded
from hearthlog.plans.oracle import ALL_ORIGINS, sql
from hearthlog.schema import SHRINK_GRID, SID

QUERIES, ORACLE = {}, {}
MIN_DAYS = 10


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


DAYS = """
cells AS (SELECT household_id, subject, CAST(at_ts AS DATE) AS date, sod, avg(home_frac) AS v, max(coalesce(zone_office, 0)) AS z
          FROM origins GROUP BY ALL),
arr AS MATERIALIZED (
  SELECT k.household_id, k.subject, k.date, list(c.v ORDER BY i.i) AS v, list(c.z ORDER BY i.i) AS z
  FROM (SELECT DISTINCT household_id, subject, date FROM cells) k CROSS JOIN range(0, 48) i(i)
  LEFT JOIN cells c ON c.household_id = k.household_id AND c.subject = k.subject AND c.date = k.date AND c.sod = i.i GROUP BY ALL),
isl AS (SELECT household_id, subject, date, i, i - row_number() OVER (PARTITION BY household_id, subject, date ORDER BY i) AS grp
        FROM (SELECT household_id, subject, date, v, unnest(range(8, 45)) AS i FROM arr) WHERE v[i + 1] IS NULL),
gaps AS (SELECT household_id, subject, date, max(n) AS gap FROM (SELECT household_id, subject, date, grp, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL),
lab AS (SELECT a.*, len(list_filter(v, lambda x: x IS NOT NULL)) AS observed_slots, coalesce(gap, 0) AS gap FROM arr a LEFT JOIN gaps USING (household_id, subject, date)),
lab2 AS (SELECT *, coalesce(v[9] >= 0.5, false) AND observed_slots >= 36 AND gap <= 2 AS candidate FROM lab),
lab3 AS (SELECT *, CASE WHEN candidate THEN list_min(list_filter(range(9, 45), lambda d: v[d] >= 0.5 AND v[d + 1] < 0.5 AND v[d + 2] < 0.5)) END AS ds,
                list_max(list_filter(range(0, 48), lambda i: z[i + 1] > 0)) AS zi FROM lab2),
days AS MATERIALIZED (
  SELECT household_id, subject, date, CAST(isodow(date) - 1 AS INT) AS dow, observed_slots, candidate, ds IS NOT NULL AS left_today,
         ds / 2 AS departure_hour,
         CASE WHEN ds IS NOT NULL THEN list_max(list_filter(range(1, 47), lambda r: r > ds AND v[r] < 0.5 AND v[r + 1] >= 0.5 AND v[r + 2] >= 0.5)) / 2 END AS return_hour,
         CAST(zi IS NOT NULL AS DOUBLE) AS "out", CASE WHEN zi IS NOT NULL THEN list_min(list_filter(range(0, 48), lambda i: i > zi AND v[i + 1] >= 0.5)) / 2 END AS out_return_hour
  FROM lab3)"""


def _causal(name, flag, hour):
    return f"""
{name}_0 AS (SELECT *, CAST({flag} AS DOUBLE) AS y, CASE WHEN {flag} THEN {hour} END AS h FROM days),
{name}_1 AS (
  SELECT *, count(y) OVER s AS wday_n0, CASE WHEN count(y) OVER s >= 3 THEN avg(y) OVER s END AS wday_rate,
         CASE WHEN count(y) OVER s >= 3 THEN median(h) OVER s END AS wday_hour, avg(y) OVER e AS all_rate, median(h) OVER e AS all_hour,
         lag(y) OVER o AS yesterday, lag(h) OVER o AS h1,
         date - max(CASE WHEN y > 0 THEN date END) OVER e AS days_since
  FROM {name}_0 WINDOW s AS (PARTITION BY household_id, subject, dow ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       e AS (PARTITION BY household_id, subject ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
       o AS (PARTITION BY household_id, subject ORDER BY date)),
{name} AS MATERIALIZED (
  SELECT *, CAST(wday_n0 AS BIGINT) AS wday_n, CASE WHEN count(yesterday) OVER r >= 3 THEN avg(yesterday) OVER r END AS recent_rate,
         CASE WHEN count(h1) OVER r >= 3 THEN median(h1) OVER r END AS recent_hour
  FROM {name}_1 WINDOW r AS (PARTITION BY household_id, subject ORDER BY date RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW))"""


LEFT = _causal("cz", "left_today", "departure_hour")
OUT = _causal("oz", '"out" > 0', "departure_hour")
DAY_SQL = ALL_ORIGINS + [DAYS]
DATE = "CAST(date - DATE '1970-01-01' AS BIGINT) AS day"


def labelled(spark, sf_dir):
    return build.table(spark, sf_dir, "days", lambda: label(spark, sf_dir))


def label(spark, sf_dir):
    return d.label_days(d.day_grid(build.day_slots(build.events(spark, sf_dir)), zones=["zone_office"]))


def day(df):
    return df.withColumn("day", F.unix_date("date").cast("long"))


@query("d1_day_grid", sql(DAY_SQL, f"""
SELECT household_id, subject, {DATE}, len(list_filter(v, lambda x: x IS NOT NULL)) AS observed, round(list_sum(v), 6) AS hours_home,
       round(v[9], 6) AS at_origin FROM arr"""))
def d1_day_grid(spark, sf_dir):
    grid = d.day_grid(build.day_slots(build.events(spark, sf_dir)))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    known = F.size(F.filter("v", lambda x: x.isNotNull()))
    return day(grid).select(*SID, "day", known.alias("observed"),
                            F.when(known > 0, rnd(total)).alias("hours_home"), rnd(F.get("v", F.lit(8))).alias("at_origin"))


DST_SQL = """
loc AS (SELECT household_id, subject, home_frac, (make_timestamp(slot * 1800000000 + 25920000000000) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Amsterdam' AS l FROM blank)"""


@query("d1_day_grid_dst", sql(ALL_ORIGINS + [DST_SQL], """
SELECT household_id, subject, CAST(CAST(l AS DATE) - DATE '1970-01-01' AS BIGINT) AS day, count(DISTINCT CASE WHEN home_frac IS NOT NULL THEN extract(hour FROM l) * 2 + extract(minute FROM l) // 30 END) AS observed,
       count(*) AS n FROM loc GROUP BY ALL"""))
def d1_day_grid_dst(spark, sf_dir):
    """The month moved to October, when Amsterdam repeats an hour."""
    table = build.slots(build.events(spark, sf_dir)).withColumn("slot", F.col("slot") + 25_920_000_000_000 // 1_800_000_000)
    grid = d.day_grid(table, "Europe/Amsterdam")
    from hearthlog.functions import clock
    n = (table.withColumn("date", F.to_date(clock.localise(clock.slot_start(F.col("slot")), "Europe/Amsterdam")))
         .groupBy(*SID, "date").agg(F.count("*").alias("n")))
    return day(grid.join(n, [*SID, "date"])).select(
        *SID, "day", F.size(F.filter("v", lambda x: x.isNotNull())).cast("long").alias("observed"), "n")


LABELS = ["observed_slots", "candidate", "left_today", "departure_hour", "return_hour"]


@query("d3_label_days", sql(DAY_SQL, f"SELECT household_id, subject, {DATE}, dow, {', '.join(LABELS)} FROM days"))
def d3_label_days(spark, sf_dir):
    return day(label(spark, sf_dir)).select(*SID, "day", "dow", *LABELS)


@query("d2_longest_gap", sql(DAY_SQL, f"SELECT household_id, subject, {DATE}, gap FROM lab"))
def d2_longest_gap(spark, sf_dir):
    return day(labelled(spark, sf_dir)).select(*SID, "day", "gap")


@query("d4_label_embargo", sql(DAY_SQL, f"""
SELECT a.household_id, a.subject, CAST(a.date - DATE '1970-01-01' AS BIGINT) AS day, count(b.date) AS n_train
FROM days a LEFT JOIN days b ON b.household_id = a.household_id AND b.subject = a.subject AND b.candidate AND b.date < a.date - INTERVAL 42 HOUR
WHERE a.candidate GROUP BY ALL"""))
def d4_label_embargo(spark, sf_dir):
    out = d.walk_forward(d.causal(labelled(spark, sf_dir)), min_days=0)
    return day(out).select(*SID, "day", "n_train")


def _causal_query(name, columns, source="cz", flag="left_today"):
    @query(name, sql(DAY_SQL + [LEFT if source == "cz" else OUT], f"SELECT household_id, subject, {DATE}, " + ", ".join(
        c if c in ("wday_n", "days_since") else f"round({c}, 6) AS {c}" for c in columns) + f" FROM {source}"))
    def run(spark, sf_dir):
        out = d.causal(labelled(spark, sf_dir), flag)
        return rounded(day(out).select(*SID, "day", *columns), *[c for c in columns if c not in ("wday_n", "days_since")])
    return run


_causal_query("d5_causal_weekday", ["wday_rate", "wday_n", "wday_hour"])
_causal_query("d6_causal_recent", ["recent_rate", "recent_hour"])
_causal_query("d7_causal_all", ["all_rate", "all_hour"])
_causal_query("d15_causal_outing", ["wday_rate", "wday_n", "recent_rate", "all_rate", "yesterday", "days_since"], "oz", "out")


@query("d8_anchor_hour", sql(DAY_SQL + [LEFT], f"SELECT household_id, subject, {DATE}, round(coalesce(wday_hour, recent_hour, all_hour), 6) AS baseline_hour FROM cz"))
def d8_anchor_hour(spark, sf_dir):
    return rounded(day(d.causal(labelled(spark, sf_dir))).select(*SID, "day", "baseline_hour"), "baseline_hour")


def _partner_sql(source, value, out):
    return sql(DAY_SQL + [LEFT if source == "cz" else OUT, f"""
r AS (SELECT *, {SQL_ROLE} AS role FROM {source})"""], "SELECT a.household_id, a.subject, CAST(a.date - DATE '1970-01-01' AS BIGINT) AS day, " + ", ".join(
        f"CASE WHEN a.role <> '{x}' THEN round(max(b.{value}) FILTER (b.role = '{x}'), 6) END AS other_{x}_{out}" for x in ROLES)
        + " FROM r a JOIN r b USING (household_id, date) GROUP BY a.household_id, a.subject, a.date, a.role")


@query("j5_partner_departure", _partner_sql("cz", "wday_hour", "wday_hour"))
def j5_partner_departure(spark, sf_dir):
    out = d.with_partners(d.causal(labelled(spark, sf_dir)).withColumn("role", role()), ROLES, "wday_hour", "wday_hour")
    names = [f"other_{x}_wday_hour" for x in ROLES]
    return rounded(day(out).select(*SID, "day", *names), *names)


QUERIES["d9_departure_features"], ORACLE["d9_departure_features"] = QUERIES["j5_partner_departure"], ORACLE["j5_partner_departure"]


@query("j6_partner_outing", _partner_sql("oz", "yesterday", "out"))
def j6_partner_outing(spark, sf_dir):
    out = d.with_partners(d.causal(labelled(spark, sf_dir), "out").withColumn("role", role()), ROLES, "yesterday", "out")
    names = [f"other_{x}_out" for x in ROLES]
    return rounded(day(out).select(*SID, "day", *names), *names)


@query("d14_label_out_days", sql(DAY_SQL, f'SELECT household_id, subject, {DATE}, "out", out_return_hour FROM days'))
def d14_label_out_days(spark, sf_dir):
    return day(labelled(spark, sf_dir)).select(*SID, "day", "out", "out_return_hour")


_G = "(VALUES " + ", ".join(f"({w}::DOUBLE, {i})" for i, w in enumerate(SHRINK_GRID)) + ") g(w, place)"


def _routine_sql(source, flag, back, house):
    return [LEFT if source == "cz" else OUT, f"""
us AS (SELECT *, {flag} AS went FROM {source} WHERE candidate {'' if house else "AND subject <> 'house'"}),
ov AS (SELECT household_id, subject, count(*) AS n, count(*) FILTER (went) AS n_went, avg(y) AS rate,
              median(departure_hour) FILTER (went) AS departure_hour, stddev_samp(departure_hour) FILTER (went) AS departure_sd, count(departure_hour) FILTER (went) AS departure_n,
              median({back}) FILTER (went) AS return_hour, stddev_samp({back}) FILTER (went) AS return_sd, count({back}) FILTER (went) AS return_n
       FROM us GROUP BY ALL HAVING count(*) >= {MIN_DAYS}),
wl AS (SELECT u.household_id, u.subject, w, place, round(avg(pow(w * wday_rate + (1 - w) * rate - y, 2)), 12) AS l
       FROM us u JOIN ov USING (household_id, subject) CROSS JOIN {_G} WHERE wday_rate IS NOT NULL GROUP BY ALL),
wt AS (SELECT household_id, subject, arg_min(w, l * 1e6 + place * 1e-9) AS weight FROM wl GROUP BY ALL),
overall AS (SELECT ov.*, CAST(coalesce(weight, 1.0) AS DOUBLE) AS shrink_weight, rate AS shrink_base FROM ov LEFT JOIN wt USING (household_id, subject)),
wd AS (SELECT u.household_id, u.subject, u.dow, count(*) AS n, count(*) FILTER (went) AS n_went, avg(y) AS rate,
              median(u.departure_hour) FILTER (went) AS departure_hour, stddev_samp(u.departure_hour) FILTER (went) AS departure_sd, count(u.departure_hour) FILTER (went) AS departure_n,
              median(u.{back}) FILTER (went) AS return_hour, stddev_samp(u.{back}) FILTER (went) AS return_sd, count(u.{back}) FILTER (went) AS return_n
       FROM us u SEMI JOIN ov USING (household_id, subject) GROUP BY ALL)"""]


NUM = ["rate", "departure_hour", "departure_sd", "return_hour", "return_sd"]
COUNTS = ["n", "n_went", "departure_n", "return_n"]


def _routine(name, source, flag, flag_sql, back, house):
    ctes = DAY_SQL + _routine_sql(source, flag_sql, back, house)

    def fitted(spark, sf_dir):
        return d.fit_routine(d.causal(labelled(spark, sf_dir), flag), flag, back, MIN_DAYS, house)

    @query(name, sql(ctes, "SELECT household_id, subject, dow, " + ", ".join(COUNTS) + ", " + ", ".join(
        f"round({c}, 6) AS {c}" for c in NUM) + ", NULL::DOUBLE AS shrink_weight FROM wd UNION ALL SELECT household_id, subject, -1, " + ", ".join(COUNTS) + ", " + ", ".join(
        f"round({c}, 6) AS {c}" for c in NUM) + ", shrink_weight FROM overall"))
    def run(spark, sf_dir):
        weekday, overall = fitted(spark, sf_dir)
        cols = [*SID, "dow", *COUNTS, *NUM, "shrink_weight"]
        both = (weekday.withColumn("shrink_weight", F.lit(None).cast("double")).select(*cols)
                .unionByName(overall.withColumn("dow", F.lit(-1)).select(*cols)))
        return rounded(both, *NUM)
    return fitted, ctes


fit_departure, DEPARTURE_SQL = _routine("d12_departure_routine", "cz", "left_today", "left_today", "return_hour", True)
fit_outing, OUTING_SQL = _routine("d16_outing_routine", "oz", "out", '"out" > 0', "out_return_hour", False)
QUERIES["d10_summarise"], ORACLE["d10_summarise"] = QUERIES["d12_departure_routine"], ORACLE["d12_departure_routine"]


def _today(name, fitted, ctes, gate):
    def hour(key):
        count = f"w.{key}_n" if gate is None else f"w.{gate}_n"
        return (f"CASE WHEN coalesce(w.n, 0) >= 3 AND coalesce(w.n_went, 0) = 0 THEN NULL WHEN coalesce({count}, 0) >= 3 AND w.{key}_hour IS NOT NULL "
                f"THEN w.{key}_hour ELSE o.{key}_hour END AS {key}_hour, CASE WHEN coalesce(w.n, 0) >= 3 AND coalesce(w.n_went, 0) = 0 THEN 'never' "
                f"WHEN coalesce({count}, 0) >= 3 AND w.{key}_hour IS NOT NULL THEN 'weekday' ELSE 'overall' END AS {key}_from")

    @query(name, sql(ctes, f"""
SELECT o.household_id, o.subject, CAST(q.dow AS BIGINT) AS dow, round_even(least(greatest(o.shrink_weight * CASE WHEN coalesce(w.n, 0) < 3 THEN o.shrink_base ELSE w.rate END + (1 - o.shrink_weight) * o.shrink_base, 0), 1), 4) AS probability,
       coalesce(w.n, 0) AS n_weekday, coalesce(w.n_went, 0) AS n_went_weekday, {hour('departure')}, {hour('return')}
FROM overall o CROSS JOIN range(0, 7) q(dow) LEFT JOIN wd w ON w.household_id = o.household_id AND w.subject = o.subject AND w.dow = q.dow"""))
    def run(spark, sf_dir):
        weekday, overall = fitted(spark, sf_dir)
        asked = overall.select(*SID, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("dow"))
        out = d.today(weekday, overall, asked, own_count=gate is None)
        return out.drop("departure_sd", "return_sd")


_today("d13_departure_today", fit_departure, DEPARTURE_SQL, None)
_today("d17_outing_today", fit_outing, OUTING_SQL, "departure")


@query("d11_fit_rate_shrink", sql(DEPARTURE_SQL, "SELECT household_id, subject, shrink_weight, round(shrink_base, 6) AS shrink_base FROM overall"))
def d11_fit_rate_shrink(spark, sf_dir):
    _weekday, overall = fit_departure(spark, sf_dir)
    return rounded(overall.select(*SID, "shrink_weight", "shrink_base"), "shrink_base")


WALK = [LEFT, f"""
cd AS (SELECT * FROM cz WHERE candidate),
pr AS (SELECT a.household_id, a.subject, a.date, a.y, a.wday_rate, b.y AS ty, b.wday_rate AS tr
       FROM cd a JOIN cd b ON b.household_id = a.household_id AND b.subject = a.subject AND b.date < a.date - INTERVAL 42 HOUR),
tb AS (SELECT household_id, subject, date, any_value(y) AS y, any_value(wday_rate) AS wday_rate, count(*) AS n_train, avg(ty) AS base FROM pr GROUP BY ALL HAVING count(*) >= 5),
ls AS (SELECT p.household_id, p.subject, p.date, w, place, round(avg(pow(w * tr + (1 - w) * base - ty, 2)), 12) AS l
       FROM pr p JOIN tb USING (household_id, subject, date) CROSS JOIN {_G} WHERE tr IS NOT NULL GROUP BY ALL),
bw AS (SELECT household_id, subject, date, arg_min(w, l * 1e6 + place * 1e-9) AS weight FROM ls GROUP BY ALL),
wf AS (SELECT t.household_id, t.subject, t.date, t.y, n_train, base, CAST(coalesce(weight, 1.0) AS DOUBLE) AS weight,
              least(greatest(coalesce(weight, 1.0) * coalesce(wday_rate, base) + (1 - coalesce(weight, 1.0)) * base, 0), 1) AS p
       FROM tb t LEFT JOIN bw USING (household_id, subject, date))"""]


@query("d18_walk_forward", sql(DAY_SQL + WALK, f"""
SELECT household_id, subject, {DATE}, n_train, weight AS shrink_weight, round(base, 6) AS shrink_base, round(p, 6) AS p_baseline FROM wf"""))
def d18_walk_forward(spark, sf_dir):
    out = d.walk_forward(d.causal(labelled(spark, sf_dir)), min_days=5)
    return rounded(day(out).select(*SID, "day", "n_train", "shrink_weight", "shrink_base", "p_baseline"), "shrink_base", "p_baseline")


@query("d20_score_subjects", sql(DAY_SQL + WALK + ["""
bk AS (SELECT *, (date - min(date) OVER (PARTITION BY household_id, subject)) // 14 AS bucket FROM wf),
pb AS (SELECT household_id, subject, bucket, count(*) AS n, sum(y) AS y, sum(pow(p - y, 2)) AS a, sum(pow(base - y, 2)) AS b FROM bk GROUP BY ALL)"""], """
SELECT household_id, subject, CAST(sum(n) AS BIGINT) AS n_scored, count(*) AS n_buckets, round(sum(y) / sum(n), 6) AS base_rate,
       round(sum(a) / sum(n), 6) AS brier, round(sum(b) / sum(n), 6) AS baseline_brier, count(*) FILTER (a < b - 1e-12) AS beat
FROM pb GROUP BY ALL"""))
def d20_score_subjects(spark, sf_dir):
    """The shrunk weekday rate scored against the plain base rate."""
    scored = d.walk_forward(d.causal(labelled(spark, sf_dir)), min_days=5)
    out = d.score_subjects(scored, "p_baseline", "shrink_base")
    return rounded(out.select(*SID, "n_scored", "n_buckets", "base_rate", "brier", "baseline_brier", "beat"), "base_rate", "brier", "baseline_brier")


@query("d20_hour_errors", sql(DAY_SQL + WALK + ["""
he AS (SELECT household_id, subject, coalesce(wday_hour, recent_hour, all_hour) - departure_hour AS e
       FROM wf w JOIN cz USING (household_id, subject, date) WHERE w.y > 0)"""], """
SELECT household_id, subject, round(avg(abs(e)), 6) AS mae_h, round(median(abs(e)), 6) AS median_ae_h, round(avg(CAST(abs(e) <= 1 AS INT)) * 100, 6) AS within_1h_pct,
       round(avg(CAST(abs(e) >= 3 AS INT)) * 100, 6) AS over_3h_pct, round(median(e), 6) AS median_signed_h
FROM he WHERE e IS NOT NULL GROUP BY ALL"""))
def d20_hour_errors(spark, sf_dir):
    out = d.hour_errors(d.walk_forward(d.causal(labelled(spark, sf_dir)), min_days=5))
    return rounded(out, "mae_h", "median_ae_h", "within_1h_pct", "over_3h_pct", "median_signed_h")
