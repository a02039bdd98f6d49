"""Points, map tiles and map features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_POINT = r"Point\(([-0-9.eE]+) ([-0-9.eE]+)\)"


def earth_point(wkt: Column) -> Column:
    """struct(lon, lat) of a point on Earth; a value with a globe prefix or
    without a point is null."""
    lon = F.regexp_extract(wkt, _POINT, 1).try_cast("double")
    lat = F.regexp_extract(wkt, _POINT, 2).try_cast("double")
    on_earth = wkt.rlike(_POINT) & ~F.ltrim(wkt).startswith("<")
    return F.when(on_earth, F.struct(lon.alias("lon"), lat.alias("lat")))


def tile(lat: Column, lon: Column, zoom: int = 8) -> Column:
    """struct(z, x, y) of the map tile that holds a position, clamped."""
    n = 2**zoom
    rad = lat * (math.pi / 180)
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n)

    def clamp(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("bigint")

    return F.struct(F.lit(zoom).cast("bigint").alias("z"), clamp(x).alias("x"), clamp(y).alias("y"))


def map_feature(way: Column, node: Column, relation: Column) -> Column:
    """struct(kind, id, via, zoom): a way before a node before a relation."""

    def feature(kind: str, value: Column, via: str, zoom: int) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), value.alias("id"), F.lit(via).alias("via"),
            F.lit(zoom).alias("zoom"),
        )

    return (
        F.when(way.isNotNull(), feature("way", way, "P10689", 15))
        .when(node.isNotNull(), feature("node", node, "P11693", 16))
        .when(relation.isNotNull(), feature("relation", relation, "P402", 11))
    )
