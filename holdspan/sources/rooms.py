"""The dimension of houses, floors, rooms and sensors: checks and areas.

``rooms``: site_id, floor_pos, floor, room_pos, room, sensor, area. ``houses``: site_id,
heated_area, total_area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdspan.functions.values import trimmed


def house_areas(rooms: DataFrame, houses: DataFrame) -> DataFrame:
    """Area of the rooms that give one, and the heated area: the house's own, else that sum."""
    room = rooms.groupBy("site_id", "floor_pos", "room_pos").agg(F.max("area").alias("area"))
    summed = room.groupBy("site_id").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("rooms_area"))
    sites = summed.join(houses, "site_id", "full_outer")
    rooms_area = F.coalesce("rooms_area", F.lit(0.0))
    return sites.select(
        "site_id",
        rooms_area.alias("rooms_area"),
        F.coalesce("heated_area", F.when(rooms_area > 0, rooms_area)).alias("heated_area"),
        F.col("heated_area").isNull().alias("heated_from_rooms"),
        "total_area",
    )


def check_rooms(rooms: DataFrame, houses: DataFrame) -> DataFrame:
    """Violations of the dimension: ``site_id, code, subject``; no rows when it is sound."""
    named = rooms.select(
        "site_id",
        "floor_pos",
        "room_pos",
        trimmed(F.col("floor")).alias("floor"),
        trimmed(F.col("room")).alias("room"),
        trimmed(F.col("sensor")).alias("sensor"),
        "area",
    )

    def found(rows: DataFrame, code: str, subject: Column) -> DataFrame:
        return rows.select("site_id", F.lit(code).alias("code"), subject.cast("string").alias("subject"))

    label = F.concat_ws(" / ", "floor", "room")
    room = named.groupBy("site_id", "floor_pos", "floor", "room_pos", "room").agg(F.max("area").alias("area"))
    floors = named.select("site_id", "floor_pos", "floor").distinct()
    empty = [
        found(floors.filter("floor = ''"), "empty_floor", F.col("floor_pos")),
        found(room.filter("room = ''"), "empty_room", F.col("floor")),
        found(named.filter("coalesce(sensor, '') = ''").select("site_id", "floor", "room").distinct(), "empty_sensor", label),
    ]
    twice = F.count(F.lit(1)) > 1
    repeated = [
        found(floors.filter("floor <> ''").groupBy("site_id", "floor").agg(twice.alias("_t")).filter("_t"), "duplicate_floor", F.col("floor")),
        found(room.filter("room <> ''").groupBy("site_id", "floor_pos", "floor", "room").agg(twice.alias("_t")).filter("_t"), "duplicate_room", label),
        found(named.groupBy("site_id", "floor_pos", "room_pos", "floor", "room", "sensor").agg(twice.alias("_t")).filter("_t"), "sensor_listed_twice", F.col("sensor")),
        found(
            named.select("site_id", "sensor", "floor_pos", "room_pos").distinct().groupBy("site_id", "sensor").agg(twice.alias("_t")).filter("_t"),
            "sensor_in_two_rooms",
            F.col("sensor"),
        ),
    ]

    def impossible(area: str) -> Column:
        value = F.col(area)
        return value.isNotNull() & (F.isnan(value) | (value <= 0) | (value == float("inf")))

    sized = [
        found(room.filter(impossible("area")), "room_area", label),
        found(houses.filter(impossible("heated_area")), "heated_area", F.col("heated_area")),
        found(houses.filter(impossible("total_area")), "total_area", F.col("total_area")),
        found(house_areas(rooms, houses).filter("total_area < heated_area"), "total_below_heated", F.col("total_area")),
    ]
    out = empty[0]
    for rows in [*empty[1:], *repeated, *sized]:
        out = out.unionByName(rows)
    return out
