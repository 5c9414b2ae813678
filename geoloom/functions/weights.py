"""Edge weights and scalar formulas of network analysis."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default speeds in km/h by road class, and the walking speed.
ROAD_SPEEDS = {
    "residential": 20,
    "primary": 40,
    "primary_link": 35,
    "motorway": 50,
    "motorway_link": 45,
    "trunk": 40,
    "trunk_link": 35,
    "secondary": 30,
    "secondary_link": 25,
    "tertiary": 30,
    "tertiary_link": 25,
    "unclassified": 20,
}
WALK_KMH = 4.5


def lookup(key: Column, table: Mapping, default) -> Column:
    """A recode by a small table; unknown and null keys give ``default``."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default)) if pairs else F.lit(default)


def travel_seconds(length_m, speed_kmh, factor: float = 1.0) -> Column:
    """Seconds for a length in metres at a speed in km/h."""
    return length_m * factor / 1000 / speed_kmh * 3600


def observed_speed(observed, fallback) -> Column:
    """The observed speed where it is positive."""
    return F.coalesce(F.when(observed > 0, observed), fallback)


def walk_seconds(distance_m, slope, top_kmh: float = WALK_KMH, floor_kmh: float = 0.1) -> Column:
    """Tobler-like walking time over a slope; null unless the distance is positive."""
    v = F.greatest(top_kmh * F.exp(-3.5 * F.abs(slope + 0.05)), F.lit(floor_kmh))
    return F.when(distance_m > 0, distance_m / 1000 * 3600 / v)


def snap_seconds(distance_m, walk_kmh: float = WALK_KMH) -> Column:
    """Walking time from a point to its node."""
    return distance_m / 1000 / walk_kmh * 3600


def road_cost(length, iri, mean_iri, base: float, slope: float) -> Column:
    """Cost of a road by its roughness; a missing value counts as the mean."""
    return length * (base + slope * F.coalesce(iri, mean_iri))


def normalized_index(a, b) -> Column:
    """(a - b) / (a + b), clipped to [-1, 1]; null where the sum is 0."""
    return F.when(a + b != 0, F.greatest(F.least((a - b) / (a + b), F.lit(1.0)), F.lit(-1.0)))


def round_significant(x) -> Column:
    """Rounded to one significant digit; 0 and null stay."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / scale) * scale)


def mph(distance_m, seconds) -> Column:
    return F.when(seconds > 0, distance_m / seconds * 3600 / 1609.34)


def urban_class(rural_share) -> Column:
    """Rural over 0.5, Intermediate between 0.2 and 0.5, Urban below 0.2; just on a border: null."""
    return (
        F.when(rural_share > 0.5, "Rural").when((rural_share > 0.2) & (rural_share < 0.5), "Intermediate").when(rural_share < 0.2, "Urban")
    )


def right_closed_bin(x, edges: list[float]) -> Column:
    """Index of the interval (edges[i], edges[i+1]] that holds x; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out


def flood_seconds(seconds, depth_u, depth_v, worst: float, fail: float) -> Column:
    """Travel time under water: the deeper end decides; depths outside (0, 10) count
    as none, from ``worst`` on the road is cut, below it the time grows with the depth."""
    clean = lambda d: F.when((d > 0) & (d < 10), d).otherwise(F.lit(0.0))
    depth = F.greatest(clean(depth_u), clean(depth_v))
    return F.when(depth >= worst, F.lit(float(fail))).when(depth > 0, seconds * worst / (worst - depth)).otherwise(seconds)


def roughness_factor(iri, smooth: float = 5.0, rough: float = 16.0, least: float = 0.5) -> Column:
    """Speed factor of a road's roughness: 1 up to ``smooth``, ``least`` from ``rough`` on, linear between."""
    return F.when(iri < smooth, 1.0).when(iri > rough, least).otherwise(1 - (1 - least) * (iri - smooth) / (rough - smooth))


def transport_cost(length_m, per_tonne_km, fixed=0.0) -> Column:
    """Money a kilogram for a length in metres at a price a tonne and kilometre, with a fixed part a tonne."""
    return (length_m / 1000 * per_tonne_km + fixed) / 1000


def log_base(x, base: float) -> Column:
    """Logarithm to a base; null unless x is positive."""
    return F.when(x > 0, F.log(x) / F.log(F.lit(float(base))))


def byte_scale(x, low, high, top: float = 255.0) -> Column:
    """Linear scale of [low, high] to [0, top], clipped and rounded down."""
    return F.floor(F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * top)


def reflectance(x, gain, offset, sun_elevation) -> Column:
    """Top-of-atmosphere reflectance of a digital number, corrected for the sun's height in degrees."""
    return (x * gain + offset) / F.sin(F.radians(sun_elevation))


def tile_code(lon, lat) -> Column:
    """Name of the one-degree tile that holds a point, as N05E036."""
    part = lambda x, pos, neg, n: F.concat(F.when(x >= 0, pos).otherwise(neg), F.lpad(F.abs(F.floor(x)).cast("string"), n, "0"))
    return F.concat(part(lat, "N", "S", 2), part(lon, "E", "W", 3))


def electrified(share, light, most: float = 0.6, dark: float = 0.23156) -> Column:
    """Two flags in one number: 10 if the electrified share exceeds ``most``, 1 if the night light exceeds ``dark``."""
    return F.coalesce((share > most).cast("int"), F.lit(0)) * 10 + F.coalesce((light > dark).cast("int"), F.lit(0))


def link_capacity(lanes, per_lane) -> Column:
    """Capacity of a link: the least of its listed lane counts times the capacity of a lane."""
    return F.array_min(lanes) * per_lane


def natural_key(text) -> Column:
    """Sort key by which numbers inside a name compare as numbers: the name with each padded to 12 digits."""
    parts = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")
