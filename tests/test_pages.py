import json
import random

import pytest
from pyspark.sql import functions as F

from innsight.operators import nested
from innsight.sources import cards, excel, workbooks

MAP = """<html><div><a href="/out">no card</a></div><div role="feed"><div><div><a class="x" href="https://m/maps/place/A/@24.5,46.25,17z?placeid=P_1&amp;hl=en"><div><div role="heading"><b>Grand &amp; Sons</b> Hotel</div>
<span role="img" aria-label="4.5 stars"></span><span>x</span><span>(1,234)</span></div><div><div>row</div><div>Hotel</div></div></a></div></div>
<div><div><a href='https://m/maps/place/B'><div role='heading'>نزل</div></a></div></div><div><div><a href="https://m/maps/none"><div>no heading</div></a></div></div></div></html>"""
BOOKING = """<div data-testid="property-card" class="c"><a data-testid="title-link" href="https://b/h1?city=1;center=24.75,-46.5;x=1"><div data-testid="title">Blue &quot;House&quot;</div></a><span data-testid="address">Olaya, Riyadh</span>
<div data-testid="review-score"><div>8.4</div>
<div>Very good</div></div><span data-testid="price-and-discounted-price">SAR 350</span></div><div class="y" data-testid='property-card'><div data-testid='title'>Plain</div><a href="https://b/h2" data-testid="title-link">go</a></div>"""


def test_cards_of_result_pages(spark):
    pages = spark.createDataFrame([(1, MAP, "c"), (2, BOOKING, "c"), (3, "", "c"), (4, None, "c"), (5, "<div role='feed'></div>", "c")], "page_id long, html string, card string").drop("card")
    got = [tuple(r) for r in cards.map_cards(pages).orderBy("page_id", "place").select("page_id", "place", "name", "rating", "reviews_count", "category", "place_id", "latitude", "longitude").collect()]
    assert got == [(1, 0, "Grand & Sons Hotel", "4.5", "1,234", "Hotel", "P_1", 24.5, 46.25), (1, 1, "نزل", None, None, None, None, None, None)]
    assert cards.map_cards(pages).orderBy("place").first()["url"] == "https://m/maps/place/A/@24.5,46.25,17z?placeid=P_1&hl=en"
    got = [tuple(r) for r in cards.booking_cards(pages).orderBy("place").select("page_id", "name", "address", "rating", "price", "url", "latitude", "longitude").collect()]
    assert got == [(2, 'Blue "House"', "Olaya, Riyadh", "8.4", "SAR 350", "https://b/h1?city=1;center=24.75,-46.5;x=1", 24.75, -46.5), (2, "Plain", None, None, None, "https://b/h2", None, None)]


def leaves(v, path=""):
    if isinstance(v, dict) and v:
        return {p: x for k, w in v.items() for p, x in leaves(w, f"{path}.{k}" if path else k).items()}
    if isinstance(v, list) and v:
        return {p: x for i, w in enumerate(v) for p, x in leaves(w, f"{path}[{i}]").items()}
    return {path: None if v is None or v in ({}, []) else str(v).lower() if isinstance(v, bool) else str(v)}


def test_json_diff_equals_a_walk_over_objects(spark):
    rnd = random.Random(4)

    def value(depth):
        pick = rnd.random()
        if depth and pick < 0.35:
            return {rnd.choice("abcd"): value(depth - 1) for _ in range(rnd.randint(0, 3))}
        if depth and pick < 0.5:
            return [value(depth - 1) for _ in range(rnd.randint(0, 2))]
        return rnd.choice([None, True, 1, 2, "x", "é", ""])

    rows = [(f"u{i % 6}", i, json.dumps({"a": value(3), "b": value(2)})) for i in range(60)] + [("bad", 1, "not json"), ("bad", 2, '{"a": 1}'), ("one", 1, '{"a": 1}'), ("bad", 3, None)]
    want = set()
    for key in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == key)
        for a, b in zip(own, own[1:]):
            x, y = ({} if t in (None, "not json") else leaves(json.loads(t)) for t in (a[2], b[2]))
            want |= {(key, b[1], p, x.get(p), y.get(p)) for p in x.keys() | y.keys() if x.get(p) != y.get(p)}
    got = [tuple(r) for r in nested.json_diff(spark.createDataFrame(rows, "url string, timestamp long, data string")).collect()]
    assert set(got) == want and len(got) == len(want) > 50


def test_changes_between_captured_pages(spark):
    page = "<title>{}</title> mail {} address: {} 4 stars owner: {}"
    rows = [("u", 1, page.format("A", "a@x.com", "Olaya street 1\n", "Ali\n")), ("u", 2, page.format("A", "b@x.com", "Olaya street 1\n", "Omar\n")), ("v", 1, "")]
    got = {tuple(r)[1:] for r in nested.snapshot_changes(spark.createDataFrame(rows, "url string, timestamp long, html string")).collect()}
    assert got == {(2, "contact_email_change", "a@x.com", "b@x.com"), (2, "hotel_owner_change", "Ali", "Omar")}
    hotels = spark.createDataFrame([(1, '{"License_no": "L1", "x": 1, "permits": {"a": 1}}'), (2, "not json"), (3, None), (4, "[1]")], "id long, additional_info string")
    assert {tuple(r) for r in nested.listed_permits(hotels).collect()} == {(1, "License_no", "L1", "Hotel Data"), (1, "permits", '{"a":1}', "Hotel Data")}


def test_workbooks_of_differing_headers(spark, tmp_path):
    spark.dataSource.register(workbooks.Workbooks)
    want = set()
    (tmp_path / "deep").mkdir()
    for i in range(10):
        own = ["name", "stars"] if i % 2 else ["stars", "city", "name"]
        data = [tuple({"name": f"hotel {i} é", "stars": float(i) if i != 4 else "four", "city": None}[c] for c in own)]
        path = tmp_path / ("deep" if i > 6 else "") / f"b{i}.xlsx"
        path.write_bytes(excel.workbook({"Hotels": (own, data), "Flags": (["open"], [(True,), (None,)])}))
        want.add((path.name, "Hotels", f"hotel {i} é", "four" if i == 4 else str(i), None))
    (tmp_path / "other.txt").write_text("no workbook")
    df = spark.read.format("workbooks").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 20 and dict(df.dtypes)["stars"] == "string" and {"file", "sheet", "open", "city"} <= set(df.columns)
    got = {(r["file"].rsplit("/", 1)[1], r["sheet"], r["name"], r["stars"], r["city"]) for r in df.where("sheet = 'Hotels'").collect()}
    assert got == want
    one = spark.read.format("workbooks").option("sheet", "Hotels").schema("name string, stars double").load(str(tmp_path / "b4.xlsx"))
    assert [tuple(r) for r in one.collect()] == [("hotel 4 é", None)]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("workbooks").load(str(tmp_path / "nowhere")).collect()
