"""Points stored along a space-filling curve, so that a search around a place reads few row groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import present

BITS = 20  # of latitude and of longitude in a key: some 20 to 40 metres


def _spread(x: Column) -> Column:
    """The lowest 32 bits of x with a zero between each two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _steps(latitude: float, longitude: float) -> tuple[int, int]:
    top = (1 << BITS) - 1
    clip = lambda v: max(0, min(top, int(v)))
    return clip((latitude + 90) / 180 * (1 << BITS)), clip((longitude + 180) / 360 * (1 << BITS))


def curve_key(latitude: Column, longitude: Column) -> Column:
    """The place on the curve: the bits of latitude and longitude in turns."""
    step = lambda v, low, wide: F.least(F.greatest(F.floor((v - low) / wide * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")
    return F.shiftleft(_spread(step(latitude, -90, 180)), 1).bitwiseOR(_spread(step(longitude, -180, 360)))


def ranges(south: float, west: float, north: float, east: float, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of curve keys, `most` at most, that cover a box; longitudes beyond 180 degrees go on from -180."""
    if west < -180 or east > 180:
        parts = [(west + 360, 180.0), (-180.0, east)] if west < -180 else [(west, 180.0), (-180.0, east - 360)]
        return [r for w, e in parts for r in ranges(south, w, north, e, most // 2)]
    (y0, x0), (y1, x1) = _steps(south, west), _steps(north, east)
    squares = [(0, 0, BITS)]  # corner and size of squares that meet the box, each a range of the curve
    while True:
        finer = []
        for y, x, bits in squares:
            inside = y0 <= y and y + (1 << bits) - 1 <= y1 and x0 <= x and x + (1 << bits) - 1 <= x1
            if inside or bits == 0:
                finer.append((y, x, bits))
                continue
            half = 1 << (bits - 1)
            finer += [(v, u, bits - 1) for v in (y, y + half) for u in (x, x + half) if v <= y1 and v + half > y0 and u <= x1 and u + half > x0]
        if len(finer) > most or finer == squares:
            break
        squares = finer
    code = lambda y, x: sum(((y >> i) & 1) << (2 * i + 1) | ((x >> i) & 1) << (2 * i) for i in range(BITS))
    out: list[tuple[int, int]] = []
    for low, high in sorted((code(y, x), code(y, x) + (1 << 2 * bits) - 1) for y, x, bits in squares):
        if out and out[-1][1] + 1 >= low:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def write_clustered(df: DataFrame, path: str, files: int | None = None, group_bytes: int = 8 << 20) -> None:
    """df (latitude, longitude, ...) as Parquet along the curve, with its key as place_key, null without a place; group_bytes: of a row group."""
    placed = present("latitude") & present("longitude")
    rows = df.withColumn("place_key", F.when(placed, curve_key(F.col("latitude"), F.col("longitude"))))
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "place_key").sortWithinPartitions("place_key").write.option("parquet.block.size", group_bytes).parquet(path)


def around(spark: SparkSession, path: str, latitude: float, longitude: float, metres: float) -> DataFrame:
    """The rows of a table of write_clustered() in a box around a place: a superset of those at most `metres` from it, for operators.search.nearby. The key's ranges are filters that the scan takes over."""
    from math import asin, cos, degrees, radians, sin

    d = metres / 6371000.0 * 1.000001 + 1e-9
    south, north = latitude - degrees(d), latitude + degrees(d)
    if south <= -90 or north >= 90 or sin(d) >= cos(radians(latitude)):
        wide = 180.0  # a pole is within reach
    else:
        wide = degrees(asin(sin(d) / cos(radians(latitude))))
    west, east = (longitude - wide, longitude + wide) if wide < 180 else (-180.0, 180.0)
    own = [F.col("place_key").between(low, high) for low, high in ranges(max(south, -90.0), west, min(north, 90.0), east)]
    return spark.read.parquet(path).where(reduce(lambda a, b: a | b, own)).drop("place_key")
