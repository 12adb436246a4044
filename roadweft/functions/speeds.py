"""Speeds of labelled roads and what they are burned as: label rules of three dialects, units, burn
values, conversion tables, colours."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweft.functions import rounded

#: Speed in mph by road type 1..7 for 1-2 lanes and for 3-12 lanes (fixed values).
MPH = {1: (55, 65), 2: (45, 55), 3: (35, 45), 4: (30, 35), 5: (25, 30), 6: (20, 20), 7: (20, 20)}
#: Road type by highway class (fixed values).
HIGHWAY = {
    1: ("motorway", "motorway_link", "trunk", "trunk_link"),
    2: ("primary", "primary_link", "bus_guideway"),
    3: ("secondary", "secondary_link"),
    4: ("tertiary", "tertiary_link"),
    5: ("residential", "living_street"),
    6: ("unclassified", "service", "road"),
    7: ("cart_track", "track"),
}
#: Classes that are no roads (fixed values).
SKIP = ("stopline", "footway", "bridleway", "step", "steps", "path", "pedestrian", "escape", "cycleway", "raceway", "bus", "services", "escalator", "sidewalk")
#: Highway types that a mask is made for (fixed values).
VALID = ("motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "unclassified", "residential", "service")
#: Speed of a channel in mph (fixed values).
CHANNEL_MPH = (7.5, 17.5, 25, 35, 45, 55, 65)
#: Lower speed of each colour above the first, and the colours (fixed values).
COLOR_FROM = (15, 25, 35, 45, 55, 65, 75)
COLORS = ("#ffffb2", "#ffe281", "#fec357", "#fe9f45", "#fa7634", "#f24624", "#da2122", "#bd0026")

MPS, MILES = 0.44704, 0.000621371
#: Factor of the speed on unpaved roads (fixed value); bridges count as other roads.
UNPAVED = 0.75
MAX_MPH, BIN_MPH, BIN_BURN = 65, 10, 36
#: Keys of properties by what they are renamed to (fixed values).
RENAMED = {"ingest_time": "ingest_tim", "bridge_type": "bridge_typ", "lane_number": "lane_numbe"}


def _by(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])[key]


def highway_type(highway: Column) -> Column:
    """Road type 1 to 7 of an OSM highway value, in any case; null if there is none."""
    return _by(F.lower(highway), {name: kind for kind, names in HIGHWAY.items() for name in names})


def mph(road_type: Column, lanes: Column, surface: Column) -> Column:
    """Speed of a road type by its lanes (1 to 12) and surface (1 paved, 2 unpaved); null for others."""
    few, many = (_by(road_type, {k: float(v[i]) for k, v in MPH.items()}) for i in (0, 1))
    return F.when(lanes.between(1, 2), few).when(lanes.between(3, 12), many) * F.when(surface == 1, 1.0).when(surface == 2, UNPAVED)


def _osm(p: Column) -> Column:
    has = lambda key: F.map_contains_key(p, key)
    kind = F.when(has("highway"), p["highway"]).when(has("class") & (p["class"] == "highway"), p["type"])
    no_road = ~has("highway") & (~has("class") | ~F.coalesce(p["class"] == "highway", F.lit(False)))
    # an unknown type is no speed, not a bad road, even in a tunnel
    known = highway_type(kind)
    speed = mph(known, F.lit(2), F.lit(1))
    return F.when(no_road | kind.isin(*SKIP), -1.0).when(known.isNotNull() & F.coalesce(p["tunnel"] == "yes", F.lit(False)), -1.0).otherwise(speed)


def _sn3(p: Column) -> Column:
    has = lambda key: F.map_contains_key(p, key)
    whole = lambda key: p[key].try_cast("double").cast("int")
    lanes = F.when(has("lane_numbe"), whole("lane_numbe")).otherwise(whole("lane_number"))
    malformed = ~(has("road_type") & (has("lane_numbe") | has("lane_number")) & has("paved") & (has("bridge_typ") | has("bridge_type")))
    # a row without one of the keys is an unclassified paved road of one lane
    return F.when(malformed, mph(F.lit(6), F.lit(1), F.lit(1))).otherwise(mph(whole("road_type"), lanes, whole("paved")))


def _sn5(p: Column) -> Column:
    surface = F.when(F.coalesce(p["surface"] == "paved", F.lit(False)), 1).otherwise(2)
    return mph(highway_type(p["highway"]), p["lanes"].try_cast("double").cast("int"), surface)


DIALECTS = {"osm": _osm, "sn3": _sn3, "sn5": _sn5}


def speed_mph(properties: Column, dialect: str) -> Column:
    """Speed in mph of a road by its properties (a map of strings); -1 for what is no road. Null where
    a value can't be read or has no speed (unknown type, over 12 lanes)."""
    return DIALECTS[dialect](properties)


def mps(speed: Column) -> Column:
    return MPS * speed


def renamed(properties: Column) -> Column:
    """Properties under their full keys; a short key's value replaces the full one's."""
    entries = F.map_entries(properties)
    for full, short in RENAMED.items():
        gone = F.filter(entries, lambda e: ~F.map_contains_key(properties, short) | (e["key"] != full))
        entries = F.transform(gone, lambda e: F.struct(F.when(e["key"] == short, F.lit(full)).otherwise(e["key"]).alias("key"), e["value"].alias("value")))
    return F.map_from_entries(entries)


def with_speeds(features: DataFrame, dialect: str) -> DataFrame:
    """``features`` (properties, ...) that have a speed, with inferred_speed_mph and _mps; roads that
    are none are dropped, and those without a speed too."""
    found = features.withColumn("properties", renamed(F.col("properties")))
    found = found.withColumn("inferred_speed_mph", speed_mph(F.col("properties"), dialect)).filter("inferred_speed_mph >= 0")
    return found.withColumn("inferred_speed_mps", rounded(mps(F.col("inferred_speed_mph")), 3))


def is_masked(highway: Column) -> Column:
    """Whether a mask is made for this highway type."""
    return F.lower(highway).isin(*VALID)


def burn_continuous(speed: Column, most: float = 255.0) -> Column:
    return F.greatest(F.least(most * speed / MAX_MPH, F.lit(most)), F.lit(0.0))


def burn_binned(speed: Column) -> Column:
    return (F.ceil(speed / BIN_MPH) * BIN_BURN).cast("int")


def channel_of_burn(burn: Column) -> Column:
    return (F.floor(burn / BIN_BURN) - 1).cast("bigint")


def binned_table(df: DataFrame) -> DataFrame:
    """speed, burn_val and channel of every whole speed of ``df`` (speed)."""
    burn = burn_binned(F.col("speed"))
    return df.select("speed", burn.alias("burn_val"), channel_of_burn(burn).cast("int").alias("channel"))


def channel_means(binned: DataFrame) -> DataFrame:
    """Per channel the truncated mean of its speeds and half an increment, and the speed it stands for."""
    found = binned.groupBy("channel").agg((F.floor(F.avg("speed")).cast("double") + 2.5).alias("mean_mph"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("mph", channel_mph(F.col("channel")))


def channel_mph(channel: Column) -> Column:
    return _by(channel.cast("int"), {c: float(v) for c, v in enumerate(CHANNEL_MPH)})


def continuous_keys() -> list[tuple[float, int]]:
    """(burn value, speed) of the continuous table, by speed; of equal burn values the last holds."""
    return sorted({max(min(255.0 * s / MAX_MPH, 255.0), 0.0): s for s in range(MAX_MPH + 1)}.items())


def nearest_speed(value: Column, keys: list[tuple[float, int]] | None = None) -> Column:
    """Speed of the burn value nearest to ``value``; of two as near the lower. ``keys`` ascend: their
    middles divide the values, and the division is found in one array, not by a join."""
    keys = keys or continuous_keys()
    middles = F.array(*[F.lit((a + b) / 2) for (a, _), (b, _) in zip(keys, keys[1:])])
    at = F.size(F.filter(middles, lambda m: m < value))
    return F.when(value.isNotNull(), F.get(F.array(*[F.lit(s) for _, s in keys]), at))


def color(speed: Column) -> Column:
    found = F.lit(COLORS[-1])
    for bound, name in reversed(list(zip(COLOR_FROM, COLORS))):
        found = F.when(speed < bound, F.lit(name)).otherwise(found)
    return found
