import datetime as dt
import json
import random
import re

from innsight.operators import search, temporal, violations


def of_one(rows):
    """(pattern, severity, n) of one hotel's events (history_id, kind, date, old, new), one event after the other."""
    low = lambda t: (t or "").lower()
    days = lambda k: [r[2].date() for r in rows if k in low(r[1]) and r[2]]
    out = set()
    for k in ("name", "owner"):
        own = days(k)
        if sum(k in low(r[1]) for r in rows) >= 2 and own and (max(own) - min(own)).days < 730:
            out.add((f"quick_{k}_changes", "high" if (max(own) - min(own)).days < 365 else "medium", 1))
    turned = sum("status" in low(r[1]) and any(a in low(r[3]) and b in low(r[4]) for a, b in (("hotel", "private"), ("hotel", "residential"), ("commercial", "residential"))) for r in rows)
    listed = [r for r in sorted(rows, key=lambda r: (r[2] or dt.datetime.min, r[0])) if re.search("listing|platform", low(r[1]))]
    private = sum(bool(re.search(temporal.OFFICIAL, low(a[4])) and re.search(temporal.PRIVATE, low(b[4]))) for a, b in zip(listed, listed[1:]))
    status = days("status")
    near = sum("name" in low(r[1]) and r[2] is not None and any(abs((r[2].date() - s).days) < 30 for s in status) for r in rows)
    out |= {(p, "high", n) for p, n in (("status_downgrade", turned), ("official_to_private", private), ("name_with_status", near)) if n}
    owned, moved = [r[2] for r in rows if "owner" in low(r[1]) and r[2]], [r[2] for r in rows if re.search("location|address", low(r[1])) and r[2]]
    if owned and moved and max(moved) > max(owned):
        out.add(("move_after_owner", "medium", 1))
    return out


def test_patterns_equal_brute_force(spark):
    rnd, rows = random.Random(11), []
    for i in range(900):
        date = None if rnd.random() < 0.05 else dt.datetime(2020, 1, 1) + dt.timedelta(days=rnd.randrange(900), hours=rnd.choice([0, 0, 23]))
        value = lambda: rnd.choice([None, "", "Hotel booking.com", "residential airbnb", "commercial Expedia", "private rental"])
        rows.append((i, rnd.randrange(60) if rnd.random() < 0.7 else 0, rnd.choice(["Name_change", "owner_change", "legal_status", "platform_change", "listing", "address", "name and status", None]), date, value(), value()))
    history = spark.createDataFrame(rows, "history_id long, hotel_id long, event_type string, event_date timestamp_ntz, old_value string, new_value string").repartition(5)
    got = sorted(tuple(r) for r in temporal.temporal_patterns(history).collect())
    hotels = {h: [(r[0], *r[2:]) for r in rows if r[1] == h] for h in {r[1] for r in rows}}
    assert got == sorted((h, *p) for h, own in hotels.items() for p in of_one(own)) and len({g[1] for g in got}) == 6
    assert temporal.temporal_patterns(history.limit(0)).count() == 0


def test_patterns_take_one_shuffle_and_no_frame_runs_against_the_sort(spark):
    history = spark.range(40).selectExpr("id history_id", "id % 3 hotel_id", "'name status' event_type", "timestamp_ntz'2020-01-01' event_date", "'hotel' old_value", "'private' new_value")
    plan = temporal.temporal_patterns(history)._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count("exchange hashpartitioning") == 1 and plan.count("window [") == 2, plan
    assert "unboundedfollowing" not in plan


def test_evasion_by_each_check(spark):
    hotels = spark.createDataFrame(
        [(1, "Grand Hotel", None, None, None, None, "active"), (2, "Sea apartment", None, "residential", '{"min stay": "3 nights"}', None, "active"), (3, "Quiet flat", None, None, '{"min stay": "30 nights"}', None, "active"),
         (4, "Licensed Hotel", '{"license": "x"}', None, None, None, "active"), (5, "Old Hotel", None, None, None, None, "inactive"), (6, "Loft studio", None, None, None, None, None)],
        "id long, name string, ownership_info string, legal_status string, additional_info string, verification_status string, operation_status string",
    ).selectExpr("*", "cast(null as double) latitude", "cast(null as double) longitude")
    listings = spark.createDataFrame([(1, 6, "a", "2023-01-01"), (2, 4, "b", "2023-01-01"), (3, 4, "b", "2024-01-01"), (4, 99, "b", "2024-01-01"), (5, 99, "b", "2023-01-01")], "listing_id long, hotel_id long, platform_id string, d string").selectExpr("*", "to_timestamp_ntz(d) first_seen_date")
    platforms = spark.createDataFrame([("a", "expedia"), ("b", "haraj")], "id string, platform_name string")
    found = lambda **kw: {r["id"]: (r["patterns"], round(r["confidence"], 6), r["score"], r["level"]) for r in violations.evasion_patterns(hotels, listings, platforms, "2024-02-01", **kw).collect()}
    want = {1: ("name_hotel_without_license", 0.8, 3, "medium"), 2: ("residential_with_high_turnover", 0.7, 3, "medium"), 4: ("platform_switching", 0.7, 2, "low"), 6: ("residential_with_high_turnover", 0.7, 3, "medium")}
    assert found() == want
    assert found(inactive=True) == want | {5: ("name_hotel_without_license", 0.8, 3, "medium")}
    assert [r["id"] for r in violations.evasion_patterns(hotels, listings, platforms, "2024-02-01", limit=1).collect()] == [1]
    assert found(least=0.75) == {1: want[1]}


def test_findings_hold_history_level_and_transitions(spark):
    rows = [(1, 1, "name_change", "2020-01-01", "a", "b"), (2, 1, "status_change", "2020-01-10", "hotel", "residential"), (3, 1, "name_change", "2020-06-01", "b", "c"), (4, 2, "other", "2020-01-01", None, None)]
    history = spark.createDataFrame(rows, "history_id long, hotel_id long, event_type string, d string, old_value string, new_value string").selectExpr("*", "to_timestamp_ntz(d) event_date")
    moves = spark.createDataFrame([(1, "2021-02-01", "vrbo", "haraj"), (1, "2021-01-01", "expedia", "vrbo")], "hotel_id long, date string, was string, now string")
    got = {r["hotel_id"]: json.loads(r["temporal_data"]) for r in temporal.findings_json(history, moves, "2024-01-01").collect()}
    # quick names, a downgrade and a name beside a status: three points each
    assert got[1]["history"] == {"events": 3, "name": 2, "owner": 0, "status": 1, "platform": 0, "location": 0, "score": 9, "level": "high"} and got[1]["as_of"] == "2024-01-01"
    assert got[1]["transitions"] == [{"date": "2021-01-01", "was": "expedia", "now": "vrbo"}, {"date": "2021-02-01", "was": "vrbo", "now": "haraj"}]
    assert (got[2]["history"]["score"], got[2]["history"]["level"]) == (0, "low") and "transitions" not in got[2]


def test_shared_phones_are_one_row_a_number(spark):
    rows = [(3, "+966 11-1"), (1, "966111"), (2, "5"), (4, None), (5, ""), (6, "x"), (7, "966-111")]
    got = {r["number"]: (r["hotels"], r["first"], r["ids"]) for r in search.shared_phones(spark.createDataFrame(rows, "id long, phone string")).collect()}
    assert got == {"966111": (3, 1, [1, 3, 7]), "": (2, 5, [5, 6])}


def test_captures_of_one_second_have_an_order(spark):
    """Captures of a second go by original, then digest, however the index is dealt and read; the rest goes by time."""
    rnd = random.Random(4)
    rows = [(f"u{rnd.randrange(8)}", f"2020010112000{rnd.randrange(6)}", rnd.choice("ab"), rnd.choice(["200", "200", "404"]), rnd.choice(["D0", "D1", "D2", None])) for _ in range(400)]
    want, good = [], sorted((r for r in rows if r[3] == "200"), key=lambda r: (*r[:3], r[4] or ""))
    for was, r in zip([None, *good], good):
        if r[4] != (was[4] if was and was[0] == r[0] else None):
            want.append((r[0], r[1], r[4] or "", f"web/{r[1]}/{r[2]}"))
    for n, order in ((1, rows), (1, rows[::-1]), (5, sorted(rows, key=lambda r: r[4] or "", reverse=True))):
        index = spark.createDataFrame(order, "url string, timestamp string, original string, statuscode string, digest string").repartition(n)
        assert sorted((r["url"], r["timestamp"], r["digest"] or "", r["archive_path"]) for r in temporal.captures(index).collect()) == sorted(want)
