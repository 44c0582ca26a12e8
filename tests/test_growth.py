"""What many rows share - a name, a place, a day, an owner - must not be met pair by pair where one row stands for all."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from innsight.operators import discovery, groups, resolve, search, space, temporal, violations, zones


def test_listings_of_one_name_meet_one_row(spark):
    """Repeats count for the smallest id of their name's likes alone, on other platforms, and come as rows, not as one array."""
    rows = [(i, "a" if i % 2 else "b", f"u{i % 300}" if i % 3 else None, "One House", float(i)) for i in range(3000)] + [(3000, "a", "x", "One Houses", 1.0), (3001, "b", None, "One Housess", 2.0)]
    df = spark.createDataFrame(rows, "id long, platform string, url string, name string, price double")
    base, repeats = discovery.listing_repeats(df)
    stays = {min(r[0] for r in rows if r[2] == u) for u in {r[2] for r in rows if r[2]}}
    assert {r["id"] for r in base.collect()} == stays | {0}
    want = [(0, p, u, c) for i, p, u, _, c in rows if i not in stays | {0} and p != "b"]
    got = [tuple(r) for r in repeats.collect()]
    key = lambda t: (t[0], t[1], t[2] or "", t[3])
    assert sorted(got, key=key) == sorted(want, key=key)


def _map(spark, crowd):
    """crowd attractions and as many hotels at each of two places, and a hotel between."""
    rows = [(2 * i + k, *at, ("attraction", "hotel")[k]) for i in range(crowd) for k in (0, 1) for at in [((24.0, 46.0), (24.001, 46.0))[i % 2]]] + [(9_000_000, 24.0004, 46.0, "hotel")]
    tags = ("building", "shop", "landuse", "amenity", "historic", "leisure", "wikipedia", "wikidata", "website", "description", "house_number", "street", "place", "postcode", "name")
    return spark.createDataFrame(rows, "osm_id long, latitude double, longitude double, tourism string").withColumns({t: F.lit(None).cast("string") for t in tags})


def test_places_not_elements_are_compared(spark):
    """20,000 attractions and 20,000 hotels at two places: four distances, and no row for a pair of elements on the way to the nearest."""
    got = zones.tourist_areas(_map(spark, 20_000)).groupBy("attraction", "metres").agg(F.count("*").alias("n")).collect()
    assert {tuple(r) for r in got} == {(0, 0.0, 10_000), (2, 0.0, 10_000), (0, 44.5, 1)}
    pairs = zones.lodging_near(_map(spark, 6), zones.attractions(_map(spark, 6)))
    assert sorted(r["metres"] for r in pairs.collect()) == [0.0] * 18 + [44.5] * 3 + [66.7] * 3 + [111.2] * 18
    lodging = zones._lodging(_map(spark, 20_000))
    assert resolve.near_places(lodging, zones._centres(zones.attractions(_map(spark, 20_000))), 0.5).count() == 6


def test_phone_pairs_in_slices(spark):
    """A number of many hotels is met in slices by many tasks, each pair once; phones without digits have no pairs."""
    rows = [(i, "+1 23" if i % 3 else "1-23") for i in range(300)] + [(400, "9"), (401, " 9"), (402, "x"), (403, "y"), (404, None)]
    pairs = search.phone_pairs(spark.createDataFrame(rows, "id long, phone string"), per_task=1000)
    assert pairs.rdd.getNumPartitions() > 30
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == 300 * 299 // 2 + 1 and set(got) == {(a, b) for a in range(300) for b in range(a + 1, 300)} | {(400, 401)}


def test_closures_are_summed_without_pairs_of_hotels(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(40), rnd.choice(["legal_status", "closure", "opening", "name"]), None if rnd.random() < 0.05 else dt.datetime(2020, 1, 1) + dt.timedelta(days=rnd.randrange(700)), rnd.choice(["closed", "open", "open, once closed", None])) for _ in range(600)]
    df = spark.createDataFrame(rows, "hotel_id long, event_type string, event_date timestamp_ntz, new_value string")
    has = lambda r, word, kind: kind in r[1] or ("status" in r[1] and word in (r[3] or ""))
    want = Counter((a[0], b[0]) for a in rows for b in rows if a[2] and b[2] and a[0] != b[0] and has(a, "closed", "closure") and has(b, "open", "opening") and 0 < (b[2].date() - a[2].date()).days <= 180)
    assert {(r["closed"], r["opened"]): r["n"] for r in temporal.closure_opening(df).collect()} == dict(want)
    assert temporal.closure_openings(df).first()[0] == sum(want.values()) > 0
    assert temporal.closure_openings(df.limit(0)).first()[0] == 0 and temporal.closure_opening(df.limit(0)).count() == 0


def test_close_events_are_dealt_by_their_pairs(spark):
    """3,000 hotels on one day make four million pairs: they come in more partitions than the session's, so that none holds them all."""
    df = spark.range(3000).select(F.col("id").alias("hotel_id"), F.lit("name").alias("event_type"), F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("event_date"))
    assert temporal._tasks(df, df, ["event_type"], 1_000_000) == 9
    few = temporal.close_events(df.where("hotel_id < 100"))
    assert few.count() == 4950 and few.agg(F.min("n"), F.max("n")).first() == (1, 1)


def test_radius_clusters_of_crowded_places(spark):
    """30,000 points at three places: each place is one row on the way, and all its points have its cluster."""
    at = [(24.0, 46.0), (24.0005, 46.0), (24.5, 46.0)]
    df = spark.createDataFrame([(i, *at[i % 3]) for i in range(30_000)], "id long, latitude double, longitude double")
    got = space.radius_clusters(df, 0.1, 10_001).groupBy("label").agg(F.count("*").alias("n")).collect()
    assert [tuple(r) for r in got] == [(0, 20_000)]
    rows = df.select("id", F.lit(None).cast("string").alias("key"), "latitude", "longitude", F.lit(False).alias("fixed"))
    assert sorted(r["id"] for r in space.first_wins(rows.unionByName(rows.selectExpr("id + 50000 AS id", "key", "CAST(NULL AS DOUBLE) AS latitude", "CAST(NULL AS DOUBLE) AS longitude", "fixed").limit(2)), 0.05).collect())[:3] == [0, 1, 2]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_counted_where_they_lie(spark):
    """Five counts of distinct values send no row once a field."""
    h = spark.createDataFrame([(1, "A", "s", "1", None, "", 3.0), (2, "B", "s", None, None, None, None)], "id long, name string, address string, phone string, email string, website string, stars double")
    li = spark.createDataFrame([(1, 1, "x", "a"), (2, 1, "y", "b"), (3, 1, "y", "C"), (4, 2, "x", "b")], "listing_id long, hotel_id long, platform_id string, name string")
    p = spark.createDataFrame([("x", "X"), ("y", "Y")], "id string, platform_name string")
    got = violations.inconsistencies(h, li, p)
    assert "Expand" not in _plan(got)
    assert [(r["id"], r["sources"], r["names"], r["addresses"], r["phones"], r["emails"], r["spread"], r["score"]) for r in got.collect()] == [(1, 3, 2, 1, 1, 0, 0.0, 2)]


def test_likeness_is_computed_once_a_hotel(spark):
    h = spark.createDataFrame([(i, f"inn {i}", "street", 24.0, 46.0, 3.0, "low", "Pool") for i in range(50)], "id long, name string, address string, latitude double, longitude double, stars double, price_range string, facilities string")
    got = search.similar(h, 6)
    held = [line for line in _plan(got).splitlines() if "levenshtein" in line]
    assert len(held) == 1 and "Generate" in held[0] and got.count() == 49


def test_pairs_are_ruled_out_by_lengths_before_texts(spark):
    """The bound by lengths is a filter of its own, below the distance of texts; blank names are equal."""
    p = spark.createDataFrame([(1, "inn", "a"), (2, "a very long name of an inn", "a"), (3, "inn", "a"), (4, "", "b"), (5, "", "b")], "id long, name string, owner string")
    p = p.withColumns({c: F.lit(None).cast("string") for c in ("address", "phone")}).withColumns({c: F.lit(None).cast("double") for c in ("latitude", "longitude")})
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "a long, b long")
    got = groups._alike(p, pairs, 0.7)
    assert "0.699999999" in _plan(got)
    assert {tuple(r) for r in got.collect()} == {(1, 3), (4, 5)}


def test_close_events_send_no_pairs(spark):
    """Each pair of hotels is given once with all its close events, wherever they meet, in slices; no row is summed after the pairs are made."""
    rnd = random.Random(9)
    rows = [(rnd.randrange(30) if rnd.random() < 0.97 else None, rnd.choice(["name", "owner", None]), None if rnd.random() < 0.05 else dt.datetime(2019, 11, 20) + dt.timedelta(days=rnd.randrange(300))) for _ in range(500)]
    df = spark.createDataFrame(rows, "hotel_id long, event_type string, event_date timestamp_ntz")
    want = Counter((a[1], a[0], b[0]) for a in rows for b in rows if None not in (*a, *b) and a[1] == b[1] and a[0] < b[0] and abs((a[2] - b[2]).days) <= 30)
    for per_task in (4_000_000, 50):
        got = temporal.close_events(df, 30, per_task)
        assert {tuple(r)[:3]: r["n"] for r in got.collect()} == dict(want) and got.count() == len(want)
        assert "Aggregate" not in _plan(got)
    assert max(want.values()) > 10
