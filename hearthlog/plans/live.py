"""The serving loop: what wakes a cycle, what it reads, what it leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthlog.operators import grid as g
from hearthlog.operators import serve as v
from hearthlog.plans import build
from hearthlog.plans.grid import rnd
from hearthlog.plans.oracle import EVENTS, S, sql
from hearthlog.plans.serve import V, current_and_curve
from hearthlog.plans.stream import stream
from hearthlog.schema import HOUSE, SID
from hearthlog.session import new_folder
from hearthlog.sources import closing, driver, forecasts
from hearthlog.streaming import ingest, trigger

QUERIES, ORACLE = {}, {}


def query(name, oracle=None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


# --- waking ------------------------------------------------------------------------

@query("v12_debounced_cycles", sql(["RECURSIVE " + EVENTS.strip(), f"""
heard AS MATERIALIZED (SELECT household_id, ts_us, lag(ts_us, 1, -1) OVER (PARTITION BY household_id ORDER BY ts_us) AS before
                       FROM (SELECT DISTINCT household_id, ts_us FROM ev)),
cyc AS (
  SELECT household_id, min(ts_us) AS cycle_us, CAST(0 AS BIGINT) AS polls FROM ev GROUP BY ALL
  UNION ALL
  SELECT household_id, greatest(t, since + polls * {trigger.POLL_US} + {trigger.FLOOR_US}), polls
  FROM (SELECT c.household_id, c.cycle_us AS since, e.ts_us AS t, (e.ts_us - c.cycle_us - 1) // {trigger.POLL_US} AS polls
        FROM cyc c JOIN heard e ON c.household_id = e.household_id AND c.cycle_us < e.ts_us AND c.cycle_us >= e.before)),
spans AS (SELECT *, lag(cycle_us, 1, -1) OVER (PARTITION BY household_id ORDER BY cycle_us) AS before FROM cyc),
open AS (SELECT (max(ts_us) // 1000 - 90 * 60000 - 1) * 1000 AS until_us FROM ev)"""], """
SELECT s.household_id, cycle_us, count(*) AS answered, polls FROM spans s JOIN ev e ON e.household_id = s.household_id AND e.ts_us <= cycle_us AND e.ts_us > before
WHERE cycle_us <= (SELECT until_us FROM open) GROUP BY s.household_id, cycle_us, polls"""))
def v12_debounced_cycles(spark, sf_dir):
    """Cycles of every household, a minute apart or more, up to the last watermark."""
    return ingest.drained(trigger.debounced(stream(spark, sf_dir), ["household_id"]), "cycles")


# --- reading -----------------------------------------------------------------------

# The log spans thirty days, so the registered pass looks back ten instead of sixty.
SERVED_FROM, LAST_DAY = "2024-01-21", "2024-01-31"
SERVED_FROM_US = 1_705_795_200_000_000


def served_table(log, closed, start: str, start_us: int):
    """The grid of a serving pass from the log's days since `start` and the one closing
    before; equal to the slots of a build over the whole history."""
    later, held = closing.window(log, closed, start)
    columns = [*SID, "ts_us", "seq", "value"]
    people = later.unionByName(held.where(F.col("subject") != HOUSE)).select(*columns)
    # The house as merged before the window is in its own closing.
    house = g.house_states(people).where(F.col("ts_us") >= start_us).select(*columns)
    signals = later.select(*columns).unionByName(house).unionByName(held.select(*columns)).withColumn("signal", F.lit("presence"))
    heard = later.select("household_id", "ts_us").unionByName(
        held.groupBy("household_id").agg(F.max("heard_us").alias("ts_us")))
    subjects = g.spine(signals.select(*SID).distinct(), heard)
    subjects = subjects.withColumn("start_slot", F.greatest("start_slot", F.lit(start_us // S)))
    out = g.integrate(signals, subjects, [g.presence({"home_frac": g.equals("home")})])
    out = out.withColumnRenamed("presence_coverage", "coverage").withColumnRenamed("presence_minutes", "minutes_in_state")
    return g.blanked(out.drop("presence_observed_us"), g.live_spans(heard), ["home_frac", "minutes_in_state"])


@query("v1_serving_scan", sql(V, f"""
SELECT c.household_id, c.subject, c.slot, round(c.state_now, 6) AS state_now, round(b.minutes_in_state, 4) AS minutes_in_state
FROM cur c JOIN blank b USING (household_id, subject, slot) WHERE c.slot * {S} >= {SERVED_FROM_US}"""))
def v1_serving_scan(spark, sf_dir):
    """Newest rows from the days looked back over, states before them carried in."""
    people = driver.person_events(build.events(spark, sf_dir))
    log, closed = new_folder(spark, "log-days"), new_folder(spark, "closings")
    closing.store(people, log)
    closing.store(closing.closings(g.presence_signals(people), F.lit(LAST_DAY).cast("date")), closed)
    table = served_table(closing.read(spark, log), closing.read(spark, closed), SERVED_FROM, SERVED_FROM_US)
    return v.current_rows(table).select(*SID, "slot", rnd("state_now").alias("state_now"), rnd("minutes_in_state", 4).alias("minutes_in_state"))


# --- keeping -----------------------------------------------------------------------

CYCLES = """
fc AS (SELECT c.household_id, c.subject, c.slot + 2 * h AS target_slot, CAST(h AS INT) AS horizon_h,
              coalesce(v.p, round_even(c.state_now, 4)) AS p, CASE WHEN v.p IS NULL THEN 1 ELSE 2 END AS written_at
       FROM cur c CROSS JOIN range(1, 49) r(h) LEFT JOIN cv v ON v.household_id = c.household_id AND v.subject = c.subject AND v.horizon_h = h)"""


def recorded(spark, sf_dir):
    """Two cycles in one store: persistence at every horizon, then the slot means where
    there are any."""
    now, curve = current_and_curve(spark, sf_dir)
    held = now.select(*SID, F.explode(F.sequence(F.lit(1), F.lit(48))).alias("horizon_h"), F.col("state_now").alias("p"))
    cycles, path = new_folder(spark, "cycles"), new_folder(spark, "forecasts")
    for number, one in ((2, curve), (1, v.curves(now, held))):
        v.forecast_rows(one, F.lit(number).cast("long")).write.mode("append").parquet(cycles)
    rows = spark.readStream.schema(spark.read.parquet(cycles).schema).parquet(cycles)
    forecasts.record(rows, path, new_folder(spark, "forecast-progress")).awaitTermination()
    return path


@query("v9_forecast_store", sql(V + [CYCLES], "SELECT * FROM fc"))
def v9_forecast_store(spark, sf_dir):
    """Two cycles over the same targets leave the later p."""
    return forecasts.read(spark, recorded(spark, sf_dir)).drop(forecasts.DAY).withColumn("written_at", F.col("written_at").cast("int"))


PRUNED_AT_US = 1_706_745_600_000_000 - 43_200_000_000


@query("v11_store_pruned", sql(V + [CYCLES], f"SELECT * FROM fc WHERE target_slot * {S} >= {PRUNED_AT_US} - 86400000000"))
def v11_store_pruned(spark, sf_dir):
    path = recorded(spark, sf_dir)
    forecasts.prune(spark, path, PRUNED_AT_US, 0)
    forecasts.prune(spark, path, PRUNED_AT_US, 1)
    return forecasts.read(spark, path).drop(forecasts.DAY).withColumn("written_at", F.col("written_at").cast("int"))
