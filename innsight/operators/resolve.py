"""Entity resolution and patterns over a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km, present
from .space import first_wins
from .violations import cells

# fixed values
STOP = ["the", "and", "in", "of", "for", "a", "an", "on", "at", "to", "by"]
HOTEL_TERMS = ["hotel", "inn", "suites", "lodge", "resort", "apartments", "hostel", "motel", "residence", "فندق", "نزل", "شقق", "أجنحة"]


def dedupe(rows: DataFrame, km: float = 0.05) -> DataFrame:
    """rows without those that repeat an earlier kept one (by id): the same name in lower case, or closer than km. Rows without a name or a place repeat none and are repeated by none."""
    whole = present("name") & present("latitude") & present("longitude")
    own = lambda c: F.when(whole, F.col(c))
    spots = rows.select("id", F.when(whole, F.lower("name")).alias("key"), own("latitude").alias("latitude"), own("longitude").alias("longitude"), F.lit(False).alias("fixed"))
    return rows.join(first_wins(spots, km), "id", "left_semi")


def owner_groups(hotels: DataFrame, owner: Column) -> DataFrame:
    key = F.lower(F.trim(owner))
    return hotels.withColumn("owner", key).where(present("owner")).groupBy("owner").agg(F.count("*").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.countDistinct("data_source").alias("sources")).where("n >= 2")


def naming_words(hotels: DataFrame, top: int = 20, of: int = 50) -> DataFrame:
    """(word, n): of the `of` words found most in names, ties by word, the first `top` of three letters or more that are no stop words."""
    words = hotels.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("word"))
    most = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(of)
    return most.where((F.length("word") > 2) & ~F.col("word").isin(STOP)).orderBy(F.desc("n"), "word").limit(top)


def naming_patterns(hotels: DataFrame) -> DataFrame:
    """(pattern, n, percent) of the patterns that names follow at all: a term of lodging after something, before something, and an article before something; percent of all names."""
    term = "|".join(HOTEL_TERMS)
    tests = {"<Name> Hotel/Inn/etc.": rf"(?U).+\s+({term})", "Hotel/Inn/etc. <Name>": rf"(?U)({term})\s+.+", "Al/The <Name>": r"(?U)(the|al)\s+.+"}
    names = hotels.where(present("name")).select(F.lower("name").alias("name"))
    counts = names.agg(F.count("*").alias("total"), *[F.count_if(F.col("name").rlike(p)).alias(k) for k, p in tests.items()])
    rows = counts.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"`{k}`").alias("n")) for k in tests])).alias("x"))
    return rows.where("x.n > 0").select("x.pattern", "x.n", (100.0 * F.col("x.n") / F.col("total")).alias("percent"))


def naming_terms(hotels: DataFrame) -> DataFrame:
    """(term, n) of words in names that say lodging."""
    words = hotels.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("term"))
    return words.where(F.col("term").isin(HOTEL_TERMS)).groupBy("term").agg(F.count("*").alias("n"))


def group_details(hotels: DataFrame, groups: DataFrame, owner: Column) -> DataFrame:
    """Per group of (id, root): n, centre, largest distance to it in km, the five words found most (twice at least), the three owners with most (two at least), sources, and whether there are several."""
    h = groups.join(hotels.withColumn("owner", owner), "id").withColumn("placed", present("latitude") & present("longitude"))
    own = lambda c: F.when(F.col("placed"), F.col(c))
    g = h.groupBy("root").agg(F.count("*").alias("n"), F.avg(own("latitude")).alias("latitude"), F.avg(own("longitude")).alias("longitude"), F.array_sort(F.collect_set("data_source")).alias("sources"))
    far = h.where("placed").select("root", F.col("latitude").alias("y"), F.col("longitude").alias("x")).join(g, "root").groupBy("root").agg(F.max(haversine_km(F.col("y"), F.col("x"), F.col("latitude"), F.col("longitude"))).alias("radius_km"))

    def most(df: DataFrame, c: str, top: int, name: str) -> DataFrame:
        n = df.groupBy("root", c).agg(F.count("*").alias("k")).where("k > 1")
        rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("k"), c))
        return n.withColumn("r", rank).where(F.col("r") <= top).groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c]), ",").alias(name))

    words = h.select("root", F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("word"))
    out = g.join(far, "root", "left").join(most(words, "word", 5, "words"), "root", "left").join(most(h.where(present("owner")), "owner", 3, "owners"), "root", "left")
    return out.select("root", "n", "latitude", "longitude", "radius_km", "words", "owners", F.array_join("sources", ",").alias("sources"), (F.size("sources") > 1).alias("several"))


def near_places(points: DataFrame, zones: DataFrame, km: float) -> DataFrame:
    """(latitude, longitude, z_lat, z_lon, km): the different places of points, with the different centres of zones (z_lat, z_lon) at most km from them, by grid cells."""
    spots, centres = points.select("latitude", "longitude").distinct(), zones.select("z_lat", "z_lon").distinct()
    j = cells(spots, km).join(cells(centres, km, "z_lat", "z_lon", around=True), ["cx", "cy", "cz"]).drop("cx", "cy", "cz")
    return j.withColumn("km", haversine_km(F.col("latitude"), F.col("longitude"), F.col("z_lat"), F.col("z_lon"))).where(F.col("km") <= km)


def within_boxes(points: DataFrame, zones: DataFrame, km: float) -> DataFrame:
    """Pairs (zone, id, km) of points at most km from a zone's centre (zone, z_lat, z_lon). A distance is taken once for two places, however many points or zones lie there."""
    return near_places(points, zones, km).join(zones, ["z_lat", "z_lon"]).join(points, ["latitude", "longitude"])


def grid_points(spark: SparkSession, latitude: float, longitude: float, radius_m: float, most: int = 16) -> DataFrame:
    """Centres and radius of the sub-areas of a city scan: a square grid of at most `most` points over the circle's box."""
    g = int(most**0.5)
    d = radius_m / 111000.0
    step = 2 * d / g
    rows = spark.range(g).select(F.col("id").alias("i")).join(spark.range(g).select(F.col("id").alias("j")))
    lat = F.lit(latitude - d) + (F.col("i") + 0.5) * step
    return rows.select(lat.alias("latitude"), (F.lit(longitude) + ((F.col("j") + 0.5) * step - d) / F.cos(F.radians(lat))).alias("longitude"), F.lit(radius_m / (0.75 * g)).alias("radius"))
