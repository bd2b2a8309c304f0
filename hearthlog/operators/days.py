"""Labels of whole days and what was known on the morning of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions import clock
from hearthlog.functions.scores import shrink, sign_test, skill_pct, fold_record_allows
from hearthlog.operators.ladder import best_weight, moments
from hearthlog.schema import HOME_THRESHOLD, HOUSE, SID, SLOTS_PER_DAY

# Where the question of a day has an answer.
ORIGIN_SLOT, LAST_DEPARTURE_SLOT = 8, 44
MIN_AWAY_SLOTS, MIN_OBSERVED_SLOTS, MAX_GAP_SLOTS = 2, 36, 2
MIN_WEEKDAY_SAMPLES, RECENT_DAYS, MIN_ROUTINE_DAYS, BUCKET_DAYS = 3, 28, 45, 14
EMBARGO_DAYS = 2


def day_grid(table: DataFrame, tz: Column | str = "UTC", zones: Sequence[str] = ()) -> DataFrame:
    """Per (subject, local date): 48 local slots as an array.

    Two slots sharing one wall-clock position are averaged.
    """
    local = clock.localise(clock.slot_start(F.col("slot")), tz)
    inside = F.greatest(*[F.coalesce(z, F.lit(0.0)) for z in zones], F.lit(0.0)) if zones else F.lit(0.0)
    cells = (table.withColumn("date", F.to_date(local)).withColumn("sod", clock.local_slot(local))
             .groupBy(*SID, "date", "sod").agg(F.avg("home_frac").alias("v"), F.max(inside).alias("z")))
    picked = cells.groupBy(*SID, "date").agg(F.map_from_entries(F.collect_list(
        F.struct("sod", F.struct("v", "z")))).alias("_m"))
    axis = F.sequence(F.lit(0), F.lit(SLOTS_PER_DAY - 1))
    return picked.select(*SID, "date",
                         F.transform(axis, lambda i: F.try_element_at("_m", i)["v"]).alias("v"),
                         F.transform(axis, lambda i: F.try_element_at("_m", i)["z"]).alias("z"))


def longest_gap(values: Column) -> Column:
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(x.isNull(), acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))
    return F.aggregate(values, start, step, lambda acc: acc["best"])


def label_days(grid: DataFrame) -> DataFrame:
    """Was the day a question at all, did they leave, and when were they back."""
    at = lambda i: F.get("v", i)
    home, away = (lambda x: x >= HOME_THRESHOLD), (lambda x: x < HOME_THRESHOLD)
    observed = F.size(F.filter("v", lambda x: x.isNotNull()))
    gap = longest_gap(F.slice("v", ORIGIN_SLOT + 1, LAST_DEPARTURE_SLOT - ORIGIN_SLOT + 1))
    candidate = (F.coalesce(home(at(F.lit(ORIGIN_SLOT))), F.lit(False)) & (F.col("observed_slots") >= MIN_OBSERVED_SLOTS)
                 & (F.col("gap") <= MAX_GAP_SLOTS))
    leaves = F.array_min(F.filter(
        F.sequence(F.lit(ORIGIN_SLOT + 1), F.lit(LAST_DEPARTURE_SLOT)),
        lambda d: home(at(d - 1)) & away(at(d)) & away(at(d + 1))))
    back = F.array_max(F.filter(
        F.sequence(F.lit(1), F.lit(SLOTS_PER_DAY - MIN_AWAY_SLOTS)),
        lambda r: (r > F.col("departure_slot")) & away(at(r - 1)) & home(at(r)) & home(at(r + 1))))
    last_in = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(47)), lambda i: F.get("z", i) > 0))
    out_back = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(47)), lambda i: (i > F.col("_in")) & home(at(i))))
    return (grid.withColumn("dow", F.weekday("date"))
            .withColumn("observed_slots", observed).withColumn("gap", gap)
            .withColumn("candidate", candidate)
            .withColumn("departure_slot", F.when(F.col("candidate"), leaves))
            .withColumn("return_slot", F.when(F.col("departure_slot").isNotNull(), back))
            .withColumn("left_today", F.col("departure_slot").isNotNull())
            .withColumn("departure_hour", F.col("departure_slot") / 2.0)
            .withColumn("return_hour", F.col("return_slot") / 2.0)
            .withColumn("_in", last_in)
            .withColumn("out", F.col("_in").isNotNull().cast("double"))
            .withColumn("out_return_hour", F.when(F.col("_in").isNotNull(), out_back / 2.0))
            .drop("v", "z", "_in"))


def causal(days: DataFrame, flag: str = "left_today", hour: str = "departure_hour") -> DataFrame:
    """A subject's own record as of each morning: strictly earlier days only.

    The trailing window runs over the shifted series: yesterday's row stamped with
    today's date. A subject has one row per day.
    """
    y = F.col(flag).cast("double")
    days = (days.withColumn("_y", y).withColumn("_h", F.when(F.col(flag).cast("boolean"), F.col(hour)))
            .withColumn("_d", F.unix_date("date")))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    same = past(Window.partitionBy(*SID, "dow").orderBy("_d"))
    ever = Window.partitionBy(*SID).orderBy("_d")
    days = (days.withColumn("wday_n", F.count("_y").over(same))
            .withColumn("wday_rate", F.when(F.col("wday_n") >= MIN_WEEKDAY_SAMPLES, F.avg("_y").over(same)))
            .withColumn("wday_hour", F.when(F.col("wday_n") >= MIN_WEEKDAY_SAMPLES, F.percentile("_h", F.lit(0.5)).over(same)))
            .withColumn("all_rate", F.avg("_y").over(past(ever)))
            .withColumn("all_hour", F.percentile("_h", F.lit(0.5)).over(past(ever)))
            .withColumn("yesterday", F.lag("_y").over(ever)).withColumn("_h1", F.lag("_h").over(ever))
            .withColumn("_out_d", F.last(F.when(F.col("_y") > 0, F.col("_d")), ignorenulls=True).over(past(ever)))
            .withColumn("days_since", F.col("_d") - F.col("_out_d")))
    lately = Window.partitionBy(*SID).orderBy("_d").rangeBetween(-(RECENT_DAYS - 1), 0)

    def enough(name, value):
        return F.when(F.count(name).over(lately) >= 3, value.over(lately))

    return (days.withColumn("recent_rate", enough("yesterday", F.avg("yesterday")))
            .withColumn("recent_hour", enough("_h1", F.percentile("_h1", F.lit(0.5))))
            .withColumn("baseline_hour", F.coalesce("wday_hour", "recent_hour", "all_hour"))
            .withColumn("is_weekend", clock.is_weekend(F.col("dow")))
            .drop("_y", "_h", "_d", "_h1", "_out_d"))


def with_partners(days: DataFrame, roles: Sequence[str], value: str, out: str) -> DataFrame:
    """The same morning of the other roles of the household; its own stays NULL."""
    wide = days.groupBy("household_id", "date").agg(
        *[F.max(F.when(F.col("role") == r, F.col(value))).alias(f"_{r}") for r in roles])
    joined = days.join(wide, ["household_id", "date"], "left")
    for r in roles:
        joined = joined.withColumn(f"other_{r}_{out}", F.when(F.col("role") != r, F.col(f"_{r}")))
    return joined.drop(*[f"_{r}" for r in roles])


def _numbers(prefix: str, value: Column, when: Column) -> dict[str, Column]:
    seen = F.when(when, value)
    return {f"{prefix}_hour": F.percentile(seen, F.lit(0.5)), f"{prefix}_sd": F.stddev_samp(seen),
            f"{prefix}_n": F.count(seen)}


def fit_routine(days: DataFrame, flag: str = "left_today", back: str = "return_hour",
                min_days: int = MIN_ROUTINE_DAYS, with_house: bool = True) -> tuple[DataFrame, DataFrame]:
    """Per subject: how often they go and at what hours, by weekday and overall.

    `days` comes from `causal`. Returns the weekday rows and the overall rows.
    """
    usable = days.where(F.col("candidate") & F.col(flag).isNotNull())
    if not with_house:
        usable = usable.where(F.col("subject") != HOUSE)
    y, went = F.col(flag).cast("double"), F.col(flag).cast("double") > 0
    common = {"n": F.count("*"), "n_went": F.count_if(went), "rate": F.avg(y),
              **_numbers("departure", F.col("departure_hour"), went), **_numbers("return", F.col(back), went)}
    weekday = usable.groupBy(*SID, "dow").agg(*[c.alias(k) for k, c in common.items()])
    overall = usable.groupBy(*SID).agg(
        *[c.alias(k) for k, c in common.items()],
        *[c.alias(k) for k, c in moments(F.col("wday_rate"), y, "w").items()])
    overall = (overall.where(F.col("n") >= min_days).withColumn("shrink_base", F.col("rate"))
               .withColumn("shrink_weight", best_weight("w", F.col("shrink_base")))
               .drop("w_n", "w_r", "w_rr", "w_ry", "w_y"))
    return weekday.join(overall.select(*SID), list(SID), "left_semi"), overall


def today(weekday: DataFrame, overall: DataFrame, asked: DataFrame, own_count: bool = True) -> DataFrame:
    """What to expect of each subject on the weekday `dow` of `asked`.

    An hour comes from the weekday when enough of its own days carry it, is absent
    on a weekday nobody ever leaves, and is the overall median otherwise. With
    `own_count` false the return hour is gated on the count of departures.
    """
    w = weekday.select(*SID, "dow", *[F.col(c).alias("w_" + c) for c in weekday.columns if c not in (*SID, "dow")])
    out = asked.join(overall, list(SID)).join(w, [*SID, "dow"], "left")
    n = F.coalesce(F.col("w_n"), F.lit(0))
    rate = F.when(n < MIN_WEEKDAY_SAMPLES, F.col("shrink_base")).otherwise(F.coalesce("w_rate", "shrink_base"))
    never = (n >= MIN_WEEKDAY_SAMPLES) & (F.coalesce("w_n_went", F.lit(0)) == 0)
    cols = {"probability": F.bround(shrink(rate, F.col("shrink_weight"), F.col("shrink_base")), 4),
            "n_weekday": n, "n_went_weekday": F.coalesce("w_n_went", F.lit(0))}
    for key in ("departure", "return"):
        count = f"w_{key}_n" if own_count else "w_departure_n"
        source = (F.when(never, "never")
                  .when((F.coalesce(count, F.lit(0)) >= MIN_WEEKDAY_SAMPLES) & F.col(f"w_{key}_hour").isNotNull(), "weekday")
                  .otherwise("overall"))
        for what in ("hour", "sd"):
            cols[f"{key}_{what}"] = (F.when(source == "weekday", F.col(f"w_{key}_{what}"))
                                     .when(source == "overall", F.col(f"{key}_{what}")))
        cols[f"{key}_from"] = source
    keep = [c for c in asked.columns]
    return out.select(*keep, *[c.alias(k) for k, c in cols.items()])


def walk_forward(days: DataFrame, flag: str = "left_today", min_days: int = 60) -> DataFrame:
    """Each candidate day predicted from the candidate days before it.

    The weekday rate shrunk toward the subject's own, with the weight fitted on the
    running sums up to the embargo; no fit per day.
    """
    y = F.col(flag).cast("double")
    usable = (days.where(F.col("candidate") & F.col(flag).isNotNull())
              .withColumn("_y", y).withColumn("_d", F.unix_date("date")))
    past = Window.partitionBy(*SID).orderBy("_d").rangeBetween(Window.unboundedPreceding, -(EMBARGO_DAYS))
    usable = usable.select(
        "*", F.count("*").over(past).alias("n_train"), F.avg("_y").over(past).alias("shrink_base"),
        F.percentile(F.when(F.col("_y") > 0, F.col("departure_hour")), F.lit(0.5)).over(past).alias("fallback_hour"),
        *[c.over(past).alias(k) for k, c in moments(F.col("wday_rate"), F.col("_y"), "w").items()])
    rate = F.coalesce("wday_rate", "shrink_base")
    return (usable.where(F.col("n_train") >= min_days)
            .withColumn("shrink_weight", best_weight("w", F.col("shrink_base")))
            .withColumn("p_baseline", shrink(rate, F.col("shrink_weight"), F.col("shrink_base")))
            .withColumn("hour_baseline", F.coalesce("baseline_hour", "fallback_hour"))
            .withColumn("label", F.col("_y"))
            .drop("w_n", "w_r", "w_rr", "w_ry", "w_y", "_y", "_d"))


def buckets(scored: DataFrame) -> DataFrame:
    """Fortnights counted from each subject's first scored day."""
    first = F.min("date").over(Window.partitionBy(*SID))
    return scored.withColumn("bucket", F.call_function("div", F.datediff("date", first), F.lit(BUCKET_DAYS)))


def score_subjects(scored: DataFrame, p: str, reference: str, min_skill: float = 15.0) -> DataFrame:
    """Brier of `p` against `reference`, with the record over fortnights."""
    sq = lambda c: (F.col(c) - F.col("label")) * (F.col(c) - F.col("label"))
    per = buckets(scored).groupBy(*SID, "bucket").agg(
        F.count("*").alias("n"), F.sum(sq(p)).alias("a"), F.sum(sq(reference)).alias("b"), F.sum("label").alias("y"))
    out = per.groupBy(*SID).agg(
        F.sum("n").alias("n_scored"), F.count("*").alias("n_buckets"), (F.sum("y") / F.sum("n")).alias("base_rate"),
        (F.sum("a") / F.sum("n")).alias("brier"), (F.sum("b") / F.sum("n")).alias("baseline_brier"),
        F.count_if(F.col("a") < F.col("b") - 1e-12).alias("beat"))
    skill = skill_pct(F.col("brier"), F.col("baseline_brier"))
    return (out.withColumn("skill_pct", skill).withColumn("sign_p", sign_test(F.col("beat"), F.col("n_buckets")))
            .withColumn("ships", F.coalesce((F.col("brier") < F.col("baseline_brier"))
                                            & fold_record_allows(F.col("beat"), F.col("n_buckets"))
                                            & (skill >= min_skill), F.lit(False))))


def hour_errors(scored: DataFrame, hour: str = "hour_baseline") -> DataFrame:
    """How far the hours were off on the days somebody left."""
    err = F.col(hour) - F.col("departure_hour")
    left = scored.where((F.col("label") > 0) & F.col(hour).isNotNull()).withColumn("_e", err)
    return left.groupBy(*SID).agg(
        F.avg(F.abs("_e")).alias("mae_h"), F.percentile(F.abs("_e"), F.lit(0.5)).alias("median_ae_h"),
        (F.avg((F.abs("_e") <= 1).cast("double")) * 100).alias("within_1h_pct"),
        (F.avg((F.abs("_e") >= 3).cast("double")) * 100).alias("over_3h_pct"),
        F.percentile("_e", F.lit(0.5)).alias("median_signed_h"))
