"""Regulatory risk: factors per hotel, reports, inconsistencies, double use, evasion patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_KM, contains_any, has_json_key, haversine_km, level, owner, present, similar_above
from .graphs import settled
from .texts import like_pairs

# fixed values
ESSENTIAL = ("name", "address", "phone", "email", "website", "stars")
SIGNIFICANT = ["name", "owner", "status", "classification"]
FACILITIES = {5: ["restaurant", "pool", "spa", "gym", "room service", "concierge"], 4: ["restaurant", "pool", "gym", "room service"]}
HOTEL_PLATFORMS = ["booking.com", "expedia", "hotels.com", "tripadvisor"]
RENTAL_PLATFORMS = ["airbnb", "vrbo", "booking_apartments"]
HOTEL_TERMS = ["hotel", "resort", "inn", "motel", "lodge"]
RESIDENTIAL_TERMS = ["apartment", "residence", "flat", "condo", "studio", "home", "house"]
RESIDENTIAL_NAMES = ["apartment", "residence", "flat", "condo", "studio"]
UNIT = r"(apt|apartment|room|suite|unit|villa)\s+(\d+[a-z]?)"
PART_WORDS = ["studio", "room in", "part of", "section", "floor"]
REGISTRATION = ["license", "permit", "registration", "certificate"]


def missing_fields(fields=ESSENTIAL) -> Column:
    return F.array_compact(F.array(*[F.when(~present(f), F.lit(f)) for f in fields]))


def _days_before(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def listing_counts(listings: DataFrame, platforms: DataFrame) -> DataFrame:
    official = F.col("is_official").cast("int")
    return listings.join(platforms.select(F.col("id").alias("platform_id"), "is_official"), "platform_id").groupBy("hotel_id").agg(F.sum(official).alias("official"), F.sum(1 - official).alias("unofficial"))


def risk_factors(hotels: DataFrame, history: DataFrame, listings: DataFrame, platforms: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Per hotel: id, name, factors (sorted), score and level. One pre-aggregation of history and one of listings, no lookups by row."""
    recent = history.where((F.col("event_date") >= _days_before(as_of, days)) & contains_any(F.col("event_type"), SIGNIFICANT)).groupBy(F.col("hotel_id").alias("id")).agg(F.count("*").alias("changes"))
    listed = listing_counts(listings, platforms).withColumnRenamed("hotel_id", "id")
    h = hotels.join(recent, "id", "left").join(listed, "id", "left").fillna(0, ["changes", "official", "unofficial"])
    lacking = {s: F.size(F.filter(F.array(*[F.lit(f) for f in own]), lambda f: ~F.lower("facilities").contains(f))) for s, own in FACILITIES.items()}
    n, o, u = F.size(missing_fields()), F.col("official"), F.col("unofficial")
    points = {
        "missing_fields": F.when(n >= 4, 3).when(n >= 2, 2).when(n >= 1, 1),
        "recent_changes": F.when(F.col("changes") >= 3, 3).when(F.col("changes") >= 2, 2).when(F.col("changes") >= 1, 1),
        "unofficial_listings": F.when((u > 0) & (o == 0), 3).when(u > o, 2).when(u > 0, 1),
        "facilities_mismatch": F.when(present("stars") & present("facilities") & (F.col("stars") >= 4) & F.when(F.col("stars") >= 5, lacking[5] >= 3).otherwise(lacking[4] >= 2), 2),
        "residential_location": F.when(present("latitude") & present("longitude") & contains_any(F.col("area_type"), ["residential"]), 2),
        "existing_score": F.when(F.col("risk_score") >= 7, 3).when(F.col("risk_score") >= 4, 2),
        "unverified": F.when(F.col("verification_status") == "unverified", 2),
    }
    found = F.array_compact(F.array(*[F.when(p.isNotNull(), F.struct(F.lit(k).alias("factor"), p.alias("points"))) for k, p in points.items()]))
    out = h.select("id", "name", "stars", "risk_score", "last_updated", found.alias("found"))
    score = F.aggregate("found", F.lit(0), lambda a, x: a + x["points"])
    return out.select("id", "name", "stars", "risk_score", "last_updated", F.array_sort(F.transform("found", lambda x: x["factor"])).alias("factors"), score.alias("score")).withColumn("level", level(F.col("score"), 7, 3))


def potential_violations(risk: DataFrame, least: int = 3, limit: int = 100) -> DataFrame:
    return risk.where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(limit).select("id", "name", F.array_join("factors", ",").alias("factors"), "score", "level")


def high_risk(risk: DataFrame, least: float = 5, sort: str = "risk_score", limit: int = 100) -> DataFrame:
    """Hotels whose stored score, or where there is none the computed one, reaches least."""
    own = F.when(present("risk_score"), F.col("risk_score")).otherwise(F.col("score").cast("double"))
    rows = risk.select("id", "name", own.alias("risk"), "stars", "last_updated").where(F.col("risk") >= least)
    key = {"risk_score": F.desc("risk"), "stars": F.desc_nulls_last("stars"), "last_updated": F.desc_nulls_last("last_updated")}[sort]
    return rows.orderBy(key, "id").limit(limit).select("id", "name", "risk")


def violations_summary(risk: DataFrame, least: int = 3) -> DataFrame:
    v = risk.where(F.col("score") >= least)
    return v.agg(F.count("*").alias("total"), *[F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low")])


def factor_counts(risk: DataFrame, least: int = 3) -> DataFrame:
    return risk.where(F.col("score") >= least).select(F.explode("factors").alias("factor")).groupBy("factor").agg(F.count("*").alias("n"))


def inconsistencies(hotels: DataFrame, listings: DataFrame, platforms: DataFrame) -> DataFrame:
    """Hotels with two sources or more whose names, addresses, phones, e-mails, websites or stars disagree. The registry is a source; listings of one platform count once, the last by listing_id.

    names, addresses, phones, emails and websites count the distinct values, in lower case; values has each field's values with their sources. Fields that listings lack are the registry's alone.
    """
    texts = ("name", "address", "phone", "email", "website")
    last = F.row_number().over(Window.partitionBy("hotel_id", "platform_name").orderBy(F.desc("listing_id")))
    field = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("double" if c == "stars" else "string").alias(c)
    named = listings.select("hotel_id", "listing_id", "platform_id", *[field(listings, c) for c in (*texts, "stars")]).join(platforms.select(F.col("id").alias("platform_id"), "platform_name"), "platform_id")
    listed = named.withColumn("r", last).where("r = 1").select(F.col("hotel_id").alias("id"), F.col("platform_name").alias("source"), *texts, "stars")
    sources = hotels.select("id", F.lit("registry").alias("source"), *texts, "stars").unionByName(listed)
    stars = F.when(present("stars"), F.col("stars"))
    values = [F.array_sort(F.collect_set(F.when(present(c), F.struct(F.lower(c).alias("value"), "source")))).alias(c) for c in texts]
    g = sources.groupBy("id").agg(F.count("*").alias("sources"), (F.max(stars) - F.min(stars)).alias("spread"), *values)
    # a hotel has few sources, so its values are counted where they lie and no row is sent once a field
    count = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["value"]))).cast("long").alias("addresses" if c == "address" else f"{c}s")
    g = g.select("id", "sources", *map(count, texts), "spread", F.struct(*texts).alias("values"))
    score = F.when(F.col("names") >= 3, 3).when(F.col("names") == 2, 2).otherwise(0) + F.when(F.col("addresses") >= 2, 3).otherwise(0) + F.when(F.col("spread") >= 2, 3).when(F.col("spread") > 1, 2).otherwise(0)
    for c in ("phones", "emails", "websites"):
        score = score + F.when(F.col(c) >= 2, 2).otherwise(0)
    out = g.where("sources >= 2").withColumn("score", score).where("score > 0")
    return out.withColumn("level", level(F.col("score"), 6, 3))


def dual_activity(hotels: DataFrame, history: DataFrame, listings: DataFrame, platforms: DataFrame) -> DataFrame:
    """(id, score, level) of hotels that look like lodging and homes at once: listed as both (3), terms of both in name and description (2), three stars or more in a residential area (3), a turn from one to the other (3)."""
    kinds = listings.join(platforms.select(F.col("id").alias("platform_id"), "platform_name", "platform_type"), "platform_id").groupBy(F.col("hotel_id").alias("id")).agg(
        F.bool_or(F.col("platform_name").isin(HOTEL_PLATFORMS) | F.col("platform_type").contains("hotel")).alias("as_hotel"),
        F.bool_or(F.col("platform_name").isin(RENTAL_PLATFORMS) | F.col("platform_type").rlike("rental|apartment")).alias("as_rental"),
    )
    turned = lambda a, b: contains_any(F.col("old_value"), a) & contains_any(F.col("new_value"), b)
    switch = history.where(contains_any(F.col("event_type"), ["classification", "status"])).groupBy(F.col("hotel_id").alias("id")).agg(F.bool_or(turned(HOTEL_TERMS, RESIDENTIAL_TERMS) | turned(RESIDENTIAL_TERMS, HOTEL_TERMS)).alias("switched"))
    said = F.concat_ws(" ", "name", F.get_json_object("additional_info", "$.description"))
    at_home = present("latitude") & present("longitude") & F.coalesce(F.col("area_type") == "residential", F.lit(False)) & F.coalesce(F.col("stars") >= 3, F.lit(False))
    h = hotels.select("id", (contains_any(said, HOTEL_TERMS) & contains_any(said, RESIDENTIAL_TERMS)).alias("mixed"), at_home.alias("at_home")).join(kinds, "id", "left").join(switch, "id", "left").fillna(False, ["as_hotel", "as_rental", "switched"])
    score = F.when(F.col("as_hotel") & F.col("as_rental"), 3).otherwise(0) + F.when(F.col("mixed"), 2).otherwise(0) + F.when(F.col("at_home"), 3).otherwise(0) + F.when(F.col("switched"), 3).otherwise(0)
    return h.select("id", score.alias("score")).where("score > 0").withColumn("level", level(F.col("score"), 5, 2))


def _by_level(df: DataFrame, *then) -> DataFrame:
    """df with the high ones first, then the medium ones."""
    return df.orderBy(F.when(F.col("level") == "high", 0).when(F.col("level") == "medium", 1).otherwise(2), *then)


def unofficial_only(hotels: DataFrame, listings: DataFrame, platforms: DataFrame, as_of: str, days: int = 30, inactive: bool = False, limit: int | None = None) -> DataFrame:
    """Hotels that only unofficial platforms list, the oldest listing `days` old or more: all at high risk; by level and id, the first `limit`."""
    counts = listing_counts(listings, platforms).where("official = 0 AND unofficial > 0")
    oldest = listings.groupBy("hotel_id").agg(F.min("first_seen_date").alias("oldest"))
    j = hotels.join(counts.join(oldest, "hotel_id").withColumnRenamed("hotel_id", "id"), "id")
    j = j if inactive else j.where("operation_status IS NULL OR operation_status != 'inactive'")
    rows = j.where(F.col("oldest").isNull() | (F.col("oldest") <= _days_before(as_of, days))).select("id", "unofficial", F.to_date("oldest").cast("string").alias("oldest"), F.lit("high").alias("level"))
    out = _by_level(rows, "id")
    return out.limit(limit) if limit else out


def residential_hotels(hotels: DataFrame, least: float = 3, limit: int | None = None) -> DataFrame:
    """Hotels with coordinates in a residential area that have `least` stars or more, or none given; by stars, highest first, the first `limit`."""
    area = F.concat_ws(" ", "area_type", *[F.get_json_object("additional_info", f"$.{k}") for k in ("area_type", "location_type", "zone_type")])
    s = F.when(present("stars"), F.col("stars"))
    rows = hotels.where(present("latitude") & present("longitude") & contains_any(area, ["residential"]) & (s.isNull() | (s >= least)))
    out = rows.select("id", "stars", F.when(s >= 4, "high").when(s.isNull() | (s >= 3), "medium").otherwise("low").alias("level")).orderBy(F.coalesce(s, F.lit(0.0)).desc(), "id")
    return out.limit(limit) if limit else out


def unlicensed() -> Column:
    """Whether a hotel is named one and nothing tells of a license."""
    status = F.lower(F.coalesce("legal_status", F.lit("")))
    licensed = (status.contains("hotel") & status.contains("license")) | has_json_key(F.col("ownership_info"), ["license", "permit"]) | has_json_key(F.col("additional_info"), ["license", "permit"])
    return contains_any(F.col("name"), ["hotel"]) & ~licensed


def home() -> Column:
    return contains_any(F.col("legal_status"), ["residential"]) | contains_any(F.col("name"), RESIDENTIAL_NAMES)


def least_nights() -> Column:
    return F.expr("try_cast(regexp_extract(coalesce(get_json_object(additional_info, '$[\\'min stay\\']'), ''), '([0-9]+)', 1) AS int)")


def name_without_license(hotels: DataFrame) -> DataFrame:
    return hotels.where(unlicensed()).select("id", F.lit(0.8).alias("confidence"))


def residential_turnover(hotels: DataFrame, listings: DataFrame, platforms: DataFrame, most_nights: int = 7) -> DataFrame:
    on_hotel = listings.join(platforms.where(F.col("platform_name").isin(HOTEL_PLATFORMS)).select(F.col("id").alias("platform_id")), "platform_id", "left_semi").select(F.col("hotel_id").alias("id"), F.lit(True).alias("on_hotel")).distinct()
    j = hotels.where(home()).join(on_hotel, "id", "left")
    return j.where(F.col("on_hotel") | (least_nights() <= most_nights)).select("id", F.lit(0.7).alias("confidence"))


def registered() -> Column:
    word = F.coalesce(F.lower("legal_status").rlike("(^|[^a-z])(registered|licensed)"), F.lit(False))
    return word | (F.coalesce(F.col("verification_status") == "verified", F.lit(False))) | has_json_key(F.col("ownership_info"), REGISTRATION) | has_json_key(F.col("additional_info"), REGISTRATION)


def unregistered_chains(hotels: DataFrame, least: float = 0.8) -> DataFrame:
    """Hotels that share an owner, by names alike, with two others or more, two of them without registration. Only distinct owner names meet."""
    h = hotels.select("id", owner(F.col("ownership_info"), F.col("additional_info")).alias("owner"), registered().alias("ok")).where("owner IS NOT NULL")
    names = h.select(F.lower("owner").alias("text")).distinct()
    pairs = like_pairs(names, least, strict=True)
    like = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(names.select(F.col("text").alias("a"), F.col("text").alias("b")))
    n = h.groupBy(F.lower("owner").alias("b")).agg(F.count("*").alias("hotels"), F.count_if(~F.col("ok")).alias("bad"))
    total = like.join(n, "b").groupBy("a").agg(F.sum("hotels").alias("hotels"), F.sum("bad").alias("bad"))
    j = h.join(total, F.lower("owner") == F.col("a")).withColumn("others", F.col("hotels") - 1).withColumn("n", F.col("bad") - F.when(F.col("ok"), 0).otherwise(1))
    return j.where("others >= 2 AND n >= 2").select("id", "others", F.col("n").alias("unregistered"), (0.7 + (F.least(F.col("n"), F.lit(5)) - 1) * 0.05).alias("confidence"))


def _switches(listings: DataFrame, platforms: DataFrame, as_of: str, days: int) -> DataFrame:
    """(id, on_hotel, both, n_recent) of each listed hotel: whether a platform for hotels has it, how many have it both from before and after the cutoff, and its listings since."""
    named = listings.join(platforms.select(F.col("id").alias("platform_id"), "platform_name"), "platform_id").withColumn("recent", F.col("first_seen_date") >= _days_before(as_of, days))
    g = named.groupBy(F.col("hotel_id").alias("id")).agg(
        F.bool_or(F.col("platform_name").isin(HOTEL_PLATFORMS)).alias("on_hotel"), F.count_if("recent").alias("n_recent"),
        F.collect_set(F.when(~F.col("recent"), F.col("platform_name"))).alias("before"), F.collect_set(F.when(F.col("recent"), F.col("platform_name"))).alias("after"),
    )
    return g.select("id", "on_hotel", F.size(F.array_intersect("before", "after")).alias("both"), "n_recent")


def _switched(recent: int) -> Column:
    return (F.col("both") > 0) | (F.col("n_recent") >= recent)


def _switch_confidence() -> Column:
    return 0.6 + 0.1 * F.least(F.col("both"), F.lit(3))


def platform_switching(listings: DataFrame, platforms: DataFrame, as_of: str, days: int = 180, recent: int = 3) -> DataFrame:
    """Hotels that are on a platform both before and after the cutoff, which they left and joined again, or that came to `recent` platforms or more since."""
    return _switches(listings, platforms, as_of, days).where(_switched(recent)).select("id", "both", "n_recent", _switch_confidence().alias("confidence"))


# fixed values
EVASION = {"name_hotel_without_license": "high", "residential_with_high_turnover": "high", "unregistered_chain_operation": "high", "split_property_listings": "medium", "platform_switching": "medium"}


def evasion_patterns(hotels: DataFrame, listings: DataFrame, platforms: DataFrame, as_of: str, least: float = 0.7, inactive: bool = False, limit: int | None = 100) -> DataFrame:
    """(id, patterns, confidence, score, level): hotels with evasion patterns of at least this confidence; a high one scores 3, a medium one 2. Highest first.

    Hotels are read once, into a table of the columns that the checks need, and listings once; the three checks that look at one hotel are one projection of their join, beside the two that compare hotels.
    """
    h = hotels if inactive else hotels.where(F.coalesce("operation_status", F.lit("")) != "inactive")
    columns = ("id", "name", "latitude", "longitude", "legal_status", "verification_status", "ownership_info", "additional_info")
    h = settled(h.select(*columns, unlicensed().alias("unlicensed"), home().alias("home"), least_nights().alias("nights")))
    made = lambda name, confidence: F.struct(F.lit(name).alias("pattern"), confidence.cast("double").alias("confidence"), F.lit(3 if EVASION[name] == "high" else 2).alias("points"))
    own = {
        "name_hotel_without_license": (F.col("unlicensed"), F.lit(0.8)),
        "residential_with_high_turnover": (F.col("home") & (F.col("on_hotel") | (F.col("nights") <= 7)), F.lit(0.7)),
        "platform_switching": (_switched(3), _switch_confidence()),
    }
    alone = h.join(_switches(listings, platforms, as_of, 180), "id", "left").select("id", F.inline(F.array_compact(F.array(*[F.when(test, made(name, c)) for name, (test, c) in own.items()]))))
    chains, parts = (df.select("id", made(name, F.col("confidence")).alias("x")).select("id", "x.*") for name, df in (("unregistered_chain_operation", unregistered_chains(h)), ("split_property_listings", split_properties(h))))
    g = alone.unionByName(chains).unionByName(parts).where(F.col("confidence") >= least).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"), F.max("confidence").alias("confidence"), F.sum("points").alias("score"))
    out = g.withColumn("level", level(F.col("score"), 5, 3)).orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit else out


def scored_clusters(hotels: DataFrame, members: DataFrame, metres: float = 100, smallest: int = 3, least: int = 3) -> DataFrame:
    """Per cluster of members (id, label): hotels, centre, owners, verified, common words, score and level of those that look unusual.

    Several owners score 2, verified beside other hotels 3, five hotels or more within 100 m 2, and words of four letters or more that stand as often as half the hotels 2.
    """
    h = members.where("label >= 0").join(hotels, "id").withColumn("owner", owner(F.col("ownership_info"), F.col("additional_info")))
    words = h.select("label", F.explode(F.split(F.lower("name"), r"\s+")).alias("word")).where(F.length("word") >= 4).groupBy("label", "word").agg(F.count("*").alias("k"))
    g = h.groupBy("label").agg(F.count("*").alias("hotels"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.countDistinct(F.when(present("owner"), F.col("owner"))).alias("owners"), F.count_if(F.col("verification_status") == "verified").alias("verified"))
    common = words.join(g.select("label", "hotels"), "label").where(F.col("k") >= F.col("hotels") / 2).groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("word")), ",").alias("words"))
    c = g.where(F.col("hotels") >= smallest).join(common, "label", "left").fillna("", ["words"])
    score = F.when(F.col("owners") > 1, 2).otherwise(0) + F.when((F.col("verified") > 0) & (F.col("verified") < F.col("hotels")), 3).otherwise(0) + F.when((F.col("hotels") >= 5) & F.lit(metres <= 100), 2).otherwise(0) + F.when(F.col("words") != "", 2).otherwise(0)
    return c.withColumn("score", score).where(F.col("score") >= least).withColumn("level", level(F.col("score"), 6, 3))


def cells(df: DataFrame, km: float, lat: str = "latitude", lon: str = "longitude", around: bool = False) -> DataFrame:
    """df with the cell (cx, cy, cz) of each point in a grid over space, in which the globe's points lie; with around, a row for each of the 27 cells about it.

    Points at most km apart on the globe are no farther apart through it, so they lie in neighbouring cells at every latitude and on both sides of 180 degrees.
    """
    d, r = km * (1 + 1e-9) + 1e-12, EARTH_KM
    a, o = F.radians(lat), F.radians(lon)
    own = df.withColumns({"cx": F.floor(r * F.cos(a) * F.cos(o) / d).cast("long"), "cy": F.floor(r * F.cos(a) * F.sin(o) / d).cast("long"), "cz": F.floor(r * F.sin(a) / d).cast("long")})
    if not around:
        return own
    near = F.expr("transform(sequence(0, 26), i -> named_struct('x', i div 9 - 1, 'y', (i div 3) % 3 - 1, 'z', i % 3 - 1))")
    return own.withColumn("_near", F.explode(near)).withColumns({c: F.col(c) + F.col(f"_near.{c[1]}") for c in ("cx", "cy", "cz")}).drop("_near")


def pairs_within(points: DataFrame, km: float, keep: list[str] = ()) -> DataFrame:
    """(a, b, km) of points (id, latitude, longitude) with a < b at most km apart, by an equi-join on grid cells; keep: columns to carry, as a_x and b_x."""
    p = points.where(present("latitude") & present("longitude")).select("id", "latitude", "longitude", *keep)
    named = lambda df, x: df.select("cx", "cy", "cz", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "latitude", "longitude", *keep)])
    j = named(cells(p, km), "a").join(named(cells(p, km, around=True), "b"), ["cx", "cy", "cz"]).where("a_id < b_id")
    j = j.withColumn("km", haversine_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")))
    return j.where(F.col("km") <= km).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "km", *[f"{x}_{c}" for x in "ab" for c in keep])


def split_properties(hotels: DataFrame, km: float = 0.05, least: float = 0.7) -> DataFrame:
    """Hotels named like a unit that have neighbours within km whose names without the unit are alike."""
    base = F.trim(F.regexp_replace(F.lower("name"), UNIT, ""))
    h = hotels.select("id", "latitude", "longitude", base.alias("base"), (F.lower("name").rlike(UNIT) | contains_any(F.col("name"), PART_WORDS)).alias("unit"))
    spots = h.where(present("latitude") & present("longitude")).groupBy("base", "latitude", "longitude").agg(F.min("id").alias("id"), F.count("*").alias("n"))  # equal names at one place are one
    near = pairs_within(spots, km, ["base", "n"]).where(similar_above(F.col("a_base"), F.col("b_base"), least))
    both = near.select(F.col("a").alias("spot"), F.col("b_n").alias("n")).unionAll(near.select(F.col("b").alias("spot"), F.col("a_n").alias("n"))).groupBy("spot").agg(F.sum("n").alias("beside"))
    own = spots.select(F.col("id").alias("spot"), "base", "latitude", "longitude", (F.col("n") - 1).alias("here")).join(both, "spot", "left")
    n = h.where("unit").select("id", "base", "latitude", "longitude").join(own, ["base", "latitude", "longitude"]).select("id", (F.col("here") + F.coalesce("beside", F.lit(0))).cast("long").alias("parts")).where("parts > 0")
    return n.select("id", "parts", (0.6 + 0.05 * F.least(F.col("parts"), F.lit(5))).alias("confidence"))
