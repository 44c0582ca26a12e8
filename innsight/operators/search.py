"""Search over the registry: criteria, names, completeness, owners, places, likeness, verification, recent changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import digits, geo_similarity, haversine_km, owner, present, similarity
from .violations import ESSENTIAL, missing_fields


def advanced_search(hotels: DataFrame, criteria: dict, listings: DataFrame | None = None, platforms: DataFrame | None = None) -> DataFrame:
    """All criteria hold: name (part of it), city, country, operation_status, risk_level, data_source ('all': any), date_from, date_to, min_stars, has_website, has_contact, official, private (yes or no)."""
    tests, out = [], hotels
    if criteria.get("name"):
        tests.append(F.lower("name").contains(criteria["name"].lower()))
    tests += [F.col(c) == criteria[c] for c in ("city", "country", "operation_status", "risk_level", "data_source") if criteria.get(c) and criteria[c] != "all"]
    tests += [op(F.col("last_updated"), F.lit(criteria[k]).try_cast("timestamp_ntz")) for k, op in (("date_from", lambda a, b: b.isNull() | (a >= b)), ("date_to", lambda a, b: b.isNull() | (a <= b))) if criteria.get(k)]
    if criteria.get("min_stars"):
        tests.append(F.col("stars") >= float(criteria["min_stars"]))
    contact = present("phone") | present("email")
    tests += [t if criteria[k] == "yes" else ~t for k, t in (("has_website", present("website")), ("has_contact", contact)) if criteria.get(k)]
    if tests:
        out = out.where(reduce(lambda a, b: a & b, tests))
    for key, official in (("official", True), ("private", False)):
        if criteria.get(key):
            on = listings.join(platforms.where(F.col("is_official") == official).select(F.col("id").alias("platform_id")), "platform_id", "left_semi").select(F.col("hotel_id").alias("id"))
            out = out.join(on, "id", "left_semi" if criteria[key] == "yes" else "left_anti")
    return out


def by_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """Any SQL over tables given by name ({name} in it), with values for its :markers."""
    return spark.sql(sql, args=values, **tables)


def by_name(hotels: DataFrame, name: str, exact: bool = False) -> DataFrame:
    return hotels.where(F.col("name") == name if exact else F.lower("name").contains(name.lower()))


def sparse(hotels: DataFrame, below: float = 0.3, fields=ESSENTIAL) -> DataFrame:
    """Hotels of whose fields a smaller share than `below` is present, with that share and the missing fields."""
    missing = missing_fields(fields)
    return hotels.withColumns({"share": 1 - F.size(missing) / max(len(fields), 1), "missing": missing}).where(F.col("share") < below).orderBy("share", "id")


def same_owner(hotels: DataFrame, hotel_id: int) -> DataFrame:
    """Other hotels whose JSON fields have the hotel's owner as a quoted text."""
    own = hotels.where(F.col("id") == hotel_id).select(owner(F.col("ownership_info"), F.col("additional_info")).alias("owner")).where("owner IS NOT NULL").limit(1)
    quoted = F.concat(F.lit('"'), "owner", F.lit('"'))
    return hotels.where(F.col("id") != hotel_id).join(F.broadcast(own), F.coalesce(F.col("ownership_info").contains(quoted), F.lit(False)) | F.coalesce(F.col("additional_info").contains(quoted), F.lit(False)))


def nearby(hotels: DataFrame, latitude: float, longitude: float, metres: float = 500) -> DataFrame:
    """Hotels within metres, with the distance to one decimal; a box of degrees comes first, so scans prune."""
    d = metres / 111000 * 1.01
    box = F.col("latitude").between(latitude - d, latitude + d)
    m = haversine_km(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude")) * 1000
    return hotels.where(box & present("latitude") & present("longitude")).withColumn("metres", m).where(F.col("metres") <= metres).withColumn("metres", F.round("metres", 1)).orderBy("metres", "id")


def similar(hotels: DataFrame, hotel_id: int, least: float = 0.7, normalised: bool = False) -> DataFrame:
    """Hotels like one: name counts 3, address 2, place 2, stars 1, price 1 or 0.5, facilities 1. The score is the sum over the number of terms; normalised: over their weights."""
    a = hotels.where(F.col("id") == hotel_id).select(*[F.col(c).alias(f"a_{c}") for c in ("name", "address", "latitude", "longitude", "stars", "price_range", "facilities")]).limit(1)
    n = int(hotels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    j = hotels.where(F.col("id") != hotel_id).repartition(n).join(F.broadcast(a))  # few bytes but much work: a file may be one task's
    both = lambda c: present(c) & present(f"a_{c}")
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("a_latitude"), F.col("a_longitude"))
    terms = [
        (3.0, F.when(both("name"), similarity(F.col("name"), F.col("a_name")))), (2.0, F.when(both("address"), similarity(F.col("address"), F.col("a_address")))),
        (2.0, F.when(both("latitude") & both("longitude"), geo_similarity(km))), (1.0, F.when(both("stars"), 1 - F.abs(F.col("stars") - F.col("a_stars")) / 5)),
        (1.0, F.when(both("facilities"), similarity(F.col("facilities"), F.col("a_facilities")))),
        (1.0, F.when(both("price_range"), F.when(F.col("price_range") == F.col("a_price_range"), 1.0).otherwise(0.5))),
    ]
    total = reduce(lambda x, y: x + y, [F.coalesce(w * t, F.lit(0.0)) for w, t in terms])
    parts = reduce(lambda x, y: x + y, [F.when(t.isNotNull(), w if normalised else 1.0).otherwise(0.0) for w, t in terms])
    scored = j.select("*", F.explode(F.array(F.try_divide(total, parts))).alias("score"))  # out of a generator, so that it is computed once
    return scored.where(F.col("score") >= least).drop(*[c for c in a.columns]).orderBy(F.desc("score"), "id")


def unverified(hotels: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return hotels.where((F.col("verification_status") == "unverified") | F.col("last_verification_date").isNull() | (F.col("last_verification_date") < cutoff)).orderBy(F.asc_nulls_first("last_verification_date"), "id")


def recent_changes(history: DataFrame, as_of: str, days: int = 7, per_hotel: int = 5) -> DataFrame:
    """The latest changes of each hotel since the cutoff, newest first."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    w = Window.partitionBy("hotel_id").orderBy(F.desc("event_date"), F.desc("history_id"))
    return history.where(F.col("event_date") >= cutoff).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_hotel)


def details(hotels: DataFrame, history: DataFrame, listings: DataFrame, hotel_id: int, relationships: DataFrame | None = None, risk: DataFrame | None = None) -> DataFrame:
    """One row: the hotel with its history and listings as sorted arrays, and where these tables are given the hotels related to it and its risk score."""
    key = F.col("hotel_id") == hotel_id
    pack = lambda df, name, *c: df.where(key).groupBy().agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    out = hotels.where(F.col("id") == hotel_id).join(pack(history, "history", "event_date", "history_id", "event_type", "old_value", "new_value")).join(pack(listings, "listings", "first_seen_date", "listing_id", "platform_id"))
    if relationships is not None:
        a, b = F.col("hotel_id_a"), F.col("hotel_id_b")
        out = out.join(relationships.where((a == hotel_id) | (b == hotel_id)).agg(F.array_sort(F.collect_set(F.when(a == hotel_id, b).otherwise(a))).alias("related")))
    return out if risk is None else out.join(risk.select("id", F.col("score").alias("computed_risk")), "id", "left")


def formatted(hotels: DataFrame, kind: str = "summary") -> DataFrame:
    or_ = lambda c, d: F.when(present(c), F.col(c).cast("string")).otherwise(d).alias(c)
    if kind == "coordinates":
        return hotels.where(present("latitude") & present("longitude")).select("id", or_("name", "Unknown"), "latitude", "longitude")
    if kind == "contacts":
        return hotels.select("id", or_("name", "Unknown"), *[or_(c, "N/A") for c in ("phone", "email", "website")])
    if kind == "detailed":
        return hotels.withColumns({c: F.when(present(c), F.col(c)).otherwise("N/A") for c in ("address", "phone", "email", "website")})
    return hotels.select("id", or_("name", "Unknown"), *[or_(c, "N/A") for c in ("city", "country", "stars")])


def shared_phones(hotels: DataFrame) -> DataFrame:
    """(number, hotels, first, ids): phone numbers, by their digits, that several hotels have, with their number, the smallest id and all ids in order. What pairs of a number say, without making them."""
    g = hotels.where("phone IS NOT NULL").groupBy(F.regexp_replace("phone", r"\D", "").alias("number")).agg(F.count("*").alias("hotels"), F.min("id").alias("first"), F.array_sort(F.collect_list("id")).alias("ids"))
    return g.where("hotels >= 2")


def phone_pairs(hotels: DataFrame, per_task: int = 4_000_000) -> DataFrame:
    """(a, b), a < b: all hotels with the same phone, by its digits. These are as many as pairs of a number, so a number's hotels are cut into slices and only slices meet: the work of
    one number spreads over tasks, about per_task pairs each, and nothing is done with a pair but to give it."""
    p = hotels.where("phone IS NOT NULL").select("id", digits(F.col("phone")).alias("d")).where("d != ''")
    n = p.groupBy("d").agg(F.count("*").cast("double").alias("n")).agg(F.max("n").alias("most"), F.sum(F.col("n") * F.col("n") / 2).alias("pairs")).first()
    tasks = max(int(hotels.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int((n["pairs"] or 0) / per_task), 20_000))
    slices = max(1, round(((n["most"] or 0) ** 2 / 2 / per_task) ** 0.5))
    slice_ = F.pmod(F.xxhash64("id"), F.lit(slices))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    a = p.select("d", F.col("id").alias("a"), slice_.cast("int").alias("i"), every.alias("j"))
    b = p.select("d", F.col("id").alias("b"), slice_.cast("int").alias("j"), every.alias("i"))
    keys = ["d", "i", "j"]
    return a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys).where("a < b").select("a", "b")
