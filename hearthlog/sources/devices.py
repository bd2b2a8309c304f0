"""From a catalog of what a household has to its subjects, zones and sensors.

A catalog has `household_id, position, entity_id, name, unit, members`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions.states import slugify
from hearthlog.schema import HOUSE

# How sensors are named.
SUFFIXES = {"distance": "_distance", "direction": "_direction_of_travel", "alarm": "_next_alarm"}


def domain(entity_id: Column) -> Column:
    return F.substring_index(entity_id, ".", 1)


def candidates(catalog: DataFrame) -> DataFrame:
    """What could be picked: people, zones but home, groups with a person, schedules."""
    d = domain(F.col("entity_id"))
    peopled = F.exists(F.coalesce("members", F.array().cast("array<string>")), lambda m: m.startswith("person."))
    kind = (F.when(d == "person", "people").when((d == "zone") & (F.col("entity_id") != "zone.home"), "zones")
            .when((d == "group") & peopled, "groups").when(d == "schedule", "schedules"))
    name = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name")).otherwise(F.col("entity_id"))
    out = catalog.withColumn("kind", kind).where("kind is not null").withColumn("label", name)
    return out.select("household_id", "kind", "entity_id", "label", F.lower("label").alias("sort_key"))


def people(catalog: DataFrame) -> DataFrame:
    return (catalog.where(domain(F.col("entity_id")) == "person")
            .select("household_id", F.col("entity_id").alias("person"), slugify(F.col("entity_id")).alias("slug")))


def match_sensors(catalog: DataFrame) -> DataFrame:
    """Each person's sensors: named by suffix and holding the person's slug.

    A slug may sit anywhere in the id, so every piece of each id is offered to an
    equality join, which reads an id once however many people there are. The first
    sensor in catalog order wins.
    """
    id_ = F.col("entity_id")
    role = F.lit(None).cast("string")
    for name, suffix in SUFFIXES.items():
        role = F.when(id_.endswith(suffix), name).otherwise(role)
    sensors = catalog.where(domain(id_) == "sensor").withColumn("role", role).where("role is not null")
    size = F.length(id_)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(
        F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(id_, i, n))))
    offered = sensors.select("household_id", "role", "position", "entity_id",
                             F.explode(F.array_distinct(pieces)).alias("slug"))
    found = people(catalog).join(offered, ["household_id", "slug"])
    return found.groupBy("household_id", "person", "slug", "role").agg(
        F.min_by("entity_id", "position").alias("entity_id"))


def proposed_subjects(catalog: DataFrame) -> DataFrame:
    """One row per person with their sensors; zones are never guessed."""
    best = match_sensors(catalog).groupBy("household_id", "person").agg(*[
        F.max(F.when(F.col("role") == r, F.col("entity_id"))).alias(f"{r}_entity") for r in SUFFIXES])
    out = people(catalog).join(best, ["household_id", "person"], "left")
    units = catalog.select("household_id", F.col("entity_id").alias("distance_entity"), "unit")
    return out.join(units, ["household_id", "distance_entity"], "left")


def proposed_households(catalog: DataFrame) -> DataFrame:
    """The first group of people is the house, if there is one."""
    groups = candidates(catalog).where("kind = 'groups'")
    house = groups.groupBy("household_id").agg(
        F.min_by("entity_id", F.struct("sort_key", "entity_id")).alias("house_entity"))
    return catalog.select("household_id").distinct().join(house, "household_id", "left")


def named(catalog: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """A catalog fact (`unit` or `name`) of the wanted entities that have it."""
    return (catalog.join(wanted.select("household_id", "entity_id").distinct(), ["household_id", "entity_id"], "left_semi")
            .where(F.coalesce(F.col(column), F.lit("")) != "").select("household_id", "entity_id", column))


def unique_slugs(entities: DataFrame, reserved: Sequence[str] = (HOUSE,)) -> DataFrame:
    """Slugs with collisions numbered `_2`, `_3`, in configured order.

    A numbered slug may meet a slug that was there by itself; the later of the two
    moves on. Names settle in the order of `position`, which is a fold over the
    household's configured names.
    """
    base = entities.withColumn("_base", slugify(F.col("entity_id")))
    listed = base.groupBy("household_id").agg(F.sort_array(F.collect_list(
        F.struct("position", "entity_id", "_base"))).alias("_all"))
    start = F.struct(F.lit(list(reserved)).cast("array<string>").alias("taken"),
                     F.array().cast("array<struct<entity_id:string,slug:string>>").alias("out"))

    def settle(acc, e):
        options = F.transform(F.sequence(F.lit(1), F.size(acc["taken"]) + 1), lambda n: F.when(
            n == 1, e["_base"]).otherwise(F.concat(e["_base"], F.lit("_"), n.cast("string"))))
        slug = F.element_at(F.filter(options, lambda s: ~F.array_contains(acc["taken"], s)), 1)
        return F.struct(F.concat(acc["taken"], F.array(slug)).alias("taken"),
                        F.concat(acc["out"], F.array(F.struct(e["entity_id"].alias("entity_id"), slug.alias("slug")))).alias("out"))

    settled = F.aggregate("_all", start, settle, lambda acc: acc["out"])
    return listed.select("household_id", F.explode(settled).alias("_s")).select("household_id", "_s.*")


def entity_sets(subjects: DataFrame, zones: DataFrame, households: DataFrame) -> DataFrame:
    """Which entities are collected, and what their changes and silences mean."""
    def rows(frame, column, **flags):
        return frame.where(F.col(column).isNotNull()).select(
            "household_id", F.col(column).alias("entity_id"),
            *[F.lit(flags.get(f, False)).alias(f) for f in ("absence", "presence", "trigger")])

    parts = [rows(subjects, "person", presence=True, trigger=True),
             rows(households, "house_entity", presence=True, trigger=True),
             rows(zones, "entity_id", trigger=True), rows(subjects, "distance_entity"),
             rows(subjects, "direction_entity"), rows(subjects, "alarm_entity", absence=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("household_id", "entity_id").agg(
        F.lit(True).alias("tracked"), *[F.bool_or(f).alias(f) for f in ("absence", "presence", "trigger")])
