"""Geospatial members: a 52-bit cell as score, haversine distances, radius search by cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Earth radius in metres, latitude bound, units, base32 alphabet of geohashes.
RADIUS_M = 6372797.560856
MAX_LAT = 85.05112878
TO_METRES = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
FROM_METRES = {"m": 1.0, "km": 0.001, "ft": 3.28084, "mi": 0.000621371}
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def valid(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-MAX_LAT, MAX_LAT)


def _cell(x: Column, low: float, high: float, bits: int) -> Column:
    return F.least(F.floor((x - low) / (high - low) * (1 << bits)), F.lit((1 << bits) - 1)).cast("bigint")


def _spread(x: Column) -> Column:
    """The bits of a 32-bit number with a zero between each two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _squeeze(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def score(lon: Column, lat: Column) -> Column:
    """GEOADD: 26 bits each of longitude (first) and latitude, interleaved."""
    return F.shiftleft(_spread(_cell(lon, -180, 180, 26)), 1).bitwiseOR(_spread(_cell(lat, -90, 90, 26)))


def position(cell: Column) -> Column:
    """GEOPOS: struct of lon and lat, the middle of the cell."""
    lon, lat = _squeeze(F.shiftright(cell, 1)), _squeeze(cell)
    return F.struct(((lon + 0.5) / (1 << 26) * 360 - 180).alias("lon"), ((lat + 0.5) / (1 << 26) * 180 - 90).alias("lat"))


def geohash(cell: Column) -> Column:
    """GEOHASH: eleven letters; the score holds 52 of their 55 bits, the rest are zero."""
    letters = [F.substring(F.lit(BASE32), F.shiftright(cell, 52 - 5 * (k + 1)).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(10)]
    last = F.substring(F.lit(BASE32), F.shiftleft(cell.bitwiseAND(3), 3).cast("int") + 1, F.lit(1))
    return F.concat(*letters, last)


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """GEODIST: haversine."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * FROM_METRES[unit]


def _bands(metres: float) -> int:
    """Number of latitude bands such that a radius spans at most two band limits."""
    return max(1, min(1 << 20, int(180 / max(metres / RADIUS_M * 57.29577951308232, 1e-9) / 1.01)))


def radius(points: DataFrame, centres: DataFrame, r: float, unit: str = "m", key: str = "key") -> DataFrame:
    """GEORADIUS for many centres (key, centre, clon, clat): members of the same key within ``r``, with ``dist`` in the unit.

    Points and centres meet by latitude band (a degree of latitude is equally
    long everywhere) and, away from the poles, by longitude cell; cells beyond the
    antimeridian wrap. Then the exact distance decides, at any radius.
    """
    metres = r * TO_METRES[unit]
    bands = _bands(metres)
    height = 180 / bands
    band = lambda lat: F.least(F.floor((lat + 90) / height), F.lit(bands - 1)).cast("bigint")
    reach = metres / RADIUS_M * 57.29577951308232 * 1.01
    # the widest span of longitude that the circle can reach, from the latitude closest to a pole
    top = F.least(F.abs("clat") + reach, F.lit(90.0))
    span = F.when(top >= 89, F.lit(360.0)).otherwise(F.lit(reach) / F.cos(F.radians(top)))
    cells = max(1, min(1 << 20, int(360 / max(2 * reach, 1e-9))))
    wide = 360 / cells
    cell = lambda lon: F.pmod(F.floor((lon + 180) / wide), F.lit(cells)).cast("bigint")
    few = F.ceil(span / wide).cast("bigint")
    at = F.floor((F.col("clon") + 180) / wide).cast("bigint")
    near = F.when(few * 2 + 1 >= cells, F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))).otherwise(F.transform(F.sequence(at - few, at + few), lambda c: F.pmod(c, F.lit(cells))))
    c = centres.withColumn("_band", F.explode(F.sequence(F.greatest(band(F.col("clat")) - 1, F.lit(0)), F.least(band(F.col("clat")) + 1, F.lit(bands - 1))))).withColumn("_cell", F.explode(near))
    p = points.withColumn("_band", band(F.col("lat"))).withColumn("_cell", cell(F.col("lon")))
    joined = p.join(c, [key, "_band", "_cell"]).withColumn("_m", distance(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat")))
    return joined.where(F.col("_m") <= metres).withColumn("dist", F.col("_m") * FROM_METRES[unit]).drop("_m", "_band", "_cell")


def radius_by_member(points: DataFrame, members: DataFrame, r: float, unit: str = "m", key: str = "key") -> DataFrame:
    """GEORADIUSBYMEMBER: centres are members (key, centre) of the same key; missing ones give nothing."""
    centres = members.join(points.select(key, F.col("member").alias("centre"), F.col("lon").alias("clon"), F.col("lat").alias("clat")), [key, "centre"])
    return radius(points, centres, r, unit, key)
