import math
import random

import pytest
from pyspark.sql import functions as F

from innsight.operators import classify, discovery, search, space, temporal, violations, zones
from innsight.sources import excel, reports, tables


def km(p, q):
    y, x, v, u = map(math.radians, (*p, *q))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lat", [0, 45, 75, 89, -89.99])
def test_pairs_within_at_every_latitude(spark, lat):
    rnd = random.Random(lat)
    d = 0.01 / max(math.cos(math.radians(lat)), 0.01)
    rows = [(i, lat + rnd.uniform(-0.005, 0.005), (180 + rnd.uniform(-d, d) + 180) % 360 - 180) for i in range(150)]
    want = {(a, b) for a, y, x in rows for b, v, u in rows if a < b and km((y, x), (v, u)) <= 0.3}
    got = violations.pairs_within(spark.createDataFrame(rows, "id long, latitude double, longitude double"), 0.3)
    assert {(r["a"], r["b"]) for r in got.collect()} == want and want


def test_dbscan_equals_sequential_model(spark):
    rnd = random.Random(3)
    points = {i: (24 + rnd.random() * 0.02, 46 + rnd.random() * 0.02) for i in range(120)}
    near = {i: [j for j in points if km(points[i], points[j]) <= 0.2] for i in points}
    core, label, n = {i for i in points if len(near[i]) >= 3}, {}, 0
    for i in points:
        if i in core and i not in label:
            stack = [i]
            while stack:
                j = stack.pop()
                if label.setdefault(j, n) == n and j in core:
                    stack += [k for k in near[j] if k not in label]
            n += 1
    got = space.dbscan(spark.createDataFrame([(i, *p) for i, p in points.items()], "id long, latitude double, longitude double"), 0.2, 3)
    assert {r["id"]: r["label"] for r in got.collect()} == {i: label.get(i, -1) for i in points}


def test_incremental_compares_with_the_known_alone(spark):
    schema = "id long, name string, latitude double, longitude double"
    old = spark.createDataFrame([(1, "Alpha", 24.0, 46.0), (2, "Beta", None, None)], schema)
    new = spark.createDataFrame([(10, "ALPHA", 10.0, 10.0), (11, "x", 24.0001, 46.0), (12, "beta", 1.0, 1.0), (13, None, 24.0, 46.0), (14, "y", 5.0, 5.0), (15, "y", 5.0, 5.0)], schema)
    assert {r["id"] for r in discovery.incremental(new, old).collect()} == {13, 14, 15}


def test_places_and_listings_without_repeats(spark):
    schema = "id long, place_id string, name string, latitude double, longitude double"
    rows = [(1, "p", "Grand Hotel", 24.0, 46.0), (2, "p", "Grand Hotel", 24.0, 46.0), (3, None, "Other", 24.0001, 46.0), (4, None, "Grand Hotels", 24.0001, 46.0), (5, None, "Far", 25.0, 46.0), (6, None, "grand hotel", None, None), (7, None, "new one", None, None), (8, None, "new ones", None, None), (9, None, None, None, None)]
    assert {r["id"] for r in discovery.places(spark.createDataFrame(rows, schema)).collect()} == {1, 3, 5, 7}
    rows = [(1, "a", "u1", "Sea View Flat", 10.0), (2, "a", "u1", "Sea View Flat", 10.0), (3, "b", None, "Sea View Flats", 9.0), (4, "b", None, "Quite other", 8.0), (5, "c", None, "Quite others", 7.0), (6, "c", None, None, 1.0)]
    got = {r["id"]: r["other_platforms"] for r in discovery.listings(spark.createDataFrame(rows, "id long, platform string, url string, name string, price double")).collect()}
    assert set(got) == {1, 4} and [x["platform"] for x in got[1]] == ["b"] and [x["platform"] for x in got[4]] == ["c"]


def similarity(a, b):
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def random_names(rnd):
    stem = rnd.choice(["Grand Hotel", "Blue House", "Sea View Flat", "نزل الرياض", "Corner"])
    return rnd.choice([None, stem, stem + "s", stem.upper(), stem + " two", stem[1:] + "xx"])


def test_places_equal_a_sequential_model(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([None, None, f"p{rnd.randint(1, 25)}"]), random_names(rnd), *((24 + rnd.random() * 0.004, 46 + rnd.random() * 0.004) if rnd.random() < 0.6 else (None, None))) for i in range(200)]
    ids, spots, kept = set(), [], []
    for r in rows:
        if r[1] and r[1] not in ids:
            ids.add(r[1])
            kept.append(r)
            if r[3]:
                spots.append(r[3:])
        elif r[3] and not any(km(r[3:], s) < 0.05 for s in spots):
            spots.append(r[3:])
            kept.append(r)
        elif r[2] and not any(k[2] and similarity(r[2], k[2]) > 0.8 for k in kept):
            kept.append(r)
    got = discovery.places(spark.createDataFrame(rows, "id long, place_id string, name string, latitude double, longitude double"))
    assert sorted(r["id"] for r in got.collect()) == [k[0] for k in kept]


def test_listings_equal_a_sequential_model(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.choice("abc"), rnd.choice([None, None, f"u{rnd.randint(1, 25)}"]), random_names(rnd), float(i)) for i in range(200)]
    urls, kept, others = set(), [], {}
    for r in rows:
        first = next((k for k in kept if r[3] and k[3] and similarity(r[3], k[3]) > 0.8), None)
        if r[2] and r[2] not in urls:
            urls.add(r[2])
            kept.append(r)
        elif r[3] and first is None:
            kept.append(r)
        elif r[3] and first[1] != r[1]:
            others.setdefault(first[0], []).append((r[1], r[2], r[4]))
    got = {r["id"]: r["other_platforms"] for r in discovery.listings(spark.createDataFrame(rows, "id long, platform string, url string, name string, price double")).collect()}
    order = lambda x: sorted(x, key=lambda v: (v[0], v[1] is not None, v[1] or "", v[2]))
    assert sorted(got) == [k[0] for k in kept] and {k: order(map(tuple, v)) for k, v in got.items() if v} == {k: order(v) for k, v in others.items()}


def test_enrichment_coordinates_and_pages(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "", "x"), (3, "c", "y")], "id long, name string, phone string")
    one, two = spark.createDataFrame([(1, "z", "11")], "id long, name string, phone string"), spark.createDataFrame([(1, "9", "m"), (2, "9", "n")], "id long, phone string, email string")
    got = {r["id"]: tuple(r)[1:] for r in discovery.filled(base, {"one": one, "two": two}).collect()}
    assert got == {1: ("a", "11", "m", "one,two"), 2: (None, "x", "n", "two"), 3: ("c", "y", None, "")}
    assert discovery.coordinates(" 24.7 , 46.6") == (24.7, 46.6) and discovery.coordinates("Riyadh") is None
    url = spark.createDataFrame([("http://m/maps/@24.5,-46.25,17z?placeid=AB_c",), ("http://b/rooms/77?x=1;center=1.5,2",), (None,)], "u string")
    got = [tuple(r) for r in url.select(*[c.alias(k) for k, c in discovery.page_place(F.col("u")).items()]).collect()]
    assert got == [("AB_c", 24.5, -46.25, None), (None, 1.5, 2.0, "77"), (None, None, None, None)]
    cities = spark.createDataFrame([("riyadh", 24.7, 46.7)], "name string, latitude double, longitude double")
    assert discovery.geocoded(spark.createDataFrame([("Riyadh ",)], "city string"), cities).first()["g_latitude"] == 24.7


def test_search_points_and_scans_stay_in_reach(spark):
    rows = [(i, f"h{i}", 24 + i * 0.02, 46.0) for i in range(12)]
    hotels = spark.createDataFrame(rows, "id long, name string, latitude double, longitude double")
    found = discovery.smart_discovery(hotels, 24.0, 46.0, metres=2500, most_points=3)
    assert {r["id"] for r in found.collect()} >= {0, 1, 2}
    assert {r["id"] for r in discovery.city_scan(hotels, 24.1, 46.0, 6000).collect()} >= {3, 4, 6, 7}


def test_map_dump_to_elements(spark):
    dump = spark.read.json(spark.sparkContext.parallelize(['{"elements": [{"id": 1, "type": "node", "lat": 24.0, "lon": 46.0, "tags": {"tourism": "hotel"}}, {"id": 2, "type": "way", "center": {"lat": 24.0, "lon": 46.0}, "tags": {"landuse": "commercial"}}, {"id": 3, "type": "way", "tags": {}}]}']), schema="elements array<struct<id: long, type: string, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string,string>>>")
    e = zones.elements(dump)
    assert {r["osm_id"] for r in e.collect()} == {1, 2}
    assert [tuple(r)[:2] for r in zones.commercial_areas(e).select("id", "zone").collect()] == [(1, 2)]


def test_workbooks_round_trip(spark, tmp_path):
    hotels = spark.createDataFrame([(1, 'A & "B" <c>', None, 4.5, "2024"), (2, "فندق", "x", None, None)], "id long, name string, address string, stars double, last_updated string")
    path = str(tmp_path / "h.xlsx")
    excel.export_excel(hotels, path)
    with open(path, "rb") as f:
        raw = f.read()
    assert excel.rows_of(raw)[1][:2] == [1.0, 'A & "B" <c>'] and excel.rows_of(raw, 1)[2] == [2.0, "فندق"]
    got = sorted(map(tuple, tables.read_file(spark, path).select("id", "name", "stars").collect()))
    assert got == [("1", 'A & "B" <c>', "4.5"), ("2", "فندق", None)]
    with pytest.raises(ValueError):
        tables.read_file(spark, "x.doc")
    (tmp_path / "h.csv").write_text("hotel_name,lat\na,1.5\n")
    (tmp_path / "h.json").write_text('[{"title": "a"}, {"title": "b"}]')
    assert tables.read_file(spark, str(tmp_path / "h.csv")).first()["lat"] == 1.5 and tables.read_file(spark, str(tmp_path / "h.json")).count() == 2


def test_reports_escape_texts(spark, tmp_path):
    hotels = spark.createDataFrame([(1, "<script>x</script>", 24.0, 46.0, 5.0, "high")], "id long, name string, latitude double, longitude double, stars double, risk_level string")
    reports.export_map(hotels, str(tmp_path / "m.html"))
    page = (tmp_path / "m.html").read_text(encoding="utf-8")
    assert "<script>x" not in page and 'fill="red"' in page
    events = spark.createDataFrame([(1, 1, "name_change", "2020-01-01", "a<b", "c", "s", "")], "history_id long, hotel_id long, event_type string, event_date string, old_value string, new_value string, source string, notes string")
    reports.export_timeline(temporal.timeline(events), str(tmp_path / "t.html"))
    assert "a&lt;b" in (tmp_path / "t.html").read_text(encoding="utf-8")
    n = spark.createDataFrame([("missing_fields", 3)], "factor string, n long")
    summary = spark.createDataFrame([(5, 2, 0, 3)], "total long, high long, medium long, low long")
    reports.export_violations(summary, hotels, n, str(tmp_path / "v.html"))
    page = (tmp_path / "v.html").read_text(encoding="utf-8")
    assert "data_collection" in page and "immediate_verification" in page and "scheduled_verification" not in page


def test_classifier_learns_saves_and_loads(spark, tmp_path):
    rows = [(i, f"grand hotel {i}" if i % 2 else f"corner shop {i}", "room bed" if i % 2 else "bread milk", i % 2) for i in range(60)]
    samples = classify.features(spark.createDataFrame(rows, "id long, name string, description string, is_hotel int"))
    model = classify.train(samples, trees=10)
    out = classify.classified(model, samples)
    m = {r["label"]: r for r in classify.metrics(out).collect()}
    assert m[1]["precision"] > 0.9 and m[1]["support"] == 30
    assert out.where("is_hotel = 1").first()["contributions"]
    classify.save(model, str(tmp_path), "model_1")
    again = classify.load_latest(spark, str(tmp_path))
    assert classify.classified(again, samples).where("likely").count() == out.where("likely").count()
    assert classify.load_latest(spark, str(tmp_path / "none")) is None


def test_criteria_are_values_not_sql(spark):
    hotels = spark.createDataFrame([(1, "a")], "id long, name string").withColumn("last_updated", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert search.advanced_search(hotels, {"date_from": "2024' OR '1"}).count() == 1
    assert search.advanced_search(hotels, {"date_from": "2024-02-01"}).count() == 0


def test_settings_keep_their_file(tmp_path):
    from innsight.settings import Settings

    s = Settings(str(tmp_path / "s.json"))
    s.set("search", "max_results", 5)
    assert Settings(str(tmp_path / "s.json")).get("search", "max_results") == 5
    s.reset("search")
    assert Settings(str(tmp_path / "s.json")).get("search", "max_results") == 100


def test_frontier_reaches_what_the_queue_reaches(spark):
    """Without budgets both find all of a grid that can be reached, and none of what lies beyond."""
    d = 0.8 / 111.0
    rows = [(i * 25 + j, f"h{i}_{j}", 24 + i * d, 46 + j * d) for i in range(20) for j in range(25) if not (i == 12 and j != 3)] + [(9000 + k, f"far{k}", 26 + k * d, 46.0) for k in range(5)]
    place = {r[0]: r[2:] for r in rows}
    queue, visited, want = [((24.0, 46.0), 5.0)], [], set()
    while queue:
        at, radius = queue.pop(0)
        if at in visited:
            continue
        visited.append(at)
        new = [i for i, p in place.items() if i not in want and km(at, p) <= radius]
        want |= set(new)
        queue += [(place[i], min(radius * 1.5, 5.0)) for i in new if all(km(place[i], v) >= 0.5 for v in visited)]
    df = spark.createDataFrame(rows, "id long, name string, latitude double, longitude double")
    found = discovery.frontier_discovery(df, 24.0, 46.0, 5000, 5000, 10**6, 10**6, per_point=None, apart_km=0.5)
    assert {r["id"] for r in found.collect()} == want and 400 < len(want) < len(rows)
    assert discovery.frontier_discovery(df, 24.0, 46.0, 1000, most_seconds=-1).count() == 3 and discovery.frontier_discovery(df, 10.0, 10.0).count() == 0


def test_plan_and_fan_out(spark):
    schema = "id long, place_id string, name string, category string, latitude double, longitude double"
    official = spark.createDataFrame([(1, "a", "Grand Hotel", "hotel", 24.0, 46.0)], schema)
    lodging = spark.createDataFrame([(2, "a", "Grand Hotel", "hotel", 24.0, 46.0), (3, "b", "Inn", "hotel", 24.1, 46.0)], schema)
    buildings = spark.createDataFrame([(4, "c", "Furnished apartments", "building", 24.2, 46.0), (5, "d", "Bakery", "shop", 24.3, 46.0)], schema)
    details = spark.createDataFrame([("a", "Grand Hotel Riyadh", "1"), ("c", "Apartments", "2")], "place_id string, name string, phone string")
    got = {r["place_id"]: (r["id"], r["name"], r["phone"]) for r in discovery.place_scan(official, lodging, buildings, details).collect()}
    assert got == {"a": (1, "Grand Hotel Riyadh", "1"), "c": (4, "Apartments", "2")}
    both = discovery.fan_out(spark, {"x": spark.range(2), "y": spark.range(3).withColumn("price", F.lit(1.0))})
    assert {(r["platform"], r["n"]) for r in both.groupBy("platform").agg(F.count("*").alias("n")).collect()} == {("x", 2), ("y", 3)} and both.where("platform = 'x' AND price IS NULL").count() == 2


def test_dual_activity_by_description_and_place(spark):
    hotels = spark.createDataFrame([(1, "Grand", '{"description": "A HOTEL with flat rooms"}', None, None, None, 5.0), (2, "x", "not json", "residential", 24.0, 46.0, 3.0), (3, "Hotel apartment", None, "residential", None, None, 5.0), (4, "apartment", None, "commercial", 24.0, 46.0, 5.0)], "id long, name string, additional_info string, area_type string, latitude double, longitude double, stars double")
    history = spark.createDataFrame([(2, "status_change", "hotel", "Home")], "hotel_id long, event_type string, old_value string, new_value string")
    listed = spark.createDataFrame([(4, "b"), (4, "a")], "hotel_id long, platform_id string")
    platforms = spark.createDataFrame([("a", "airbnb", "rental"), ("b", "booking.com", "hotel")], "id string, platform_name string, platform_type string")
    got = {r["id"]: (r["score"], r["level"]) for r in violations.dual_activity(hotels, history, listed, platforms).collect()}
    assert got == {1: (2, "medium"), 2: (6, "high"), 3: (2, "medium"), 4: (3, "medium")}


def test_present_goes_by_type(spark):
    from innsight.functions.scalars import present

    df = spark.createDataFrame([("0", 0.0, 0, None), ("", 0.5, 1, "x"), ("0.0", None, None, "")], "a string, b double, c long, d string")
    got = [tuple(r) for r in df.select(*[present(c).alias(c) for c in "abcd"]).collect()]
    assert got == [(True, False, False, False), (False, True, True, True), (True, False, False, False)]
