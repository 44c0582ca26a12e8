import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from innsight.functions import scalars as f
from innsight.operators import resolve, temporal
from innsight.plans.registry import ORACLE_SQL, QUERIES
from innsight.sources.tables import normalised

SF = "/root/testdata/sf0.001"


def test_similarity_and_phones(spark):
    df = spark.createDataFrame([("نزل", "نزال", "+966 11 123456", "0011-123456"), ("", "", "12345", "12345"), ("abc", None, "999123456", "888123456")], "a string, b string, p string, q string")
    rows = df.select(f.similarity(F.col("a"), F.col("b")), f.phone_similarity(F.col("p"), F.col("q"))).collect()
    assert rows[0][0] == pytest.approx(0.75) and rows[0][1] == 0.9
    assert rows[1] == (1.0, 1.0) and rows[2] == (0.0, 0.9)


def test_haversine_is_clamped(spark):
    got = spark.range(1).select(f.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert got == pytest.approx(6371.0 * 3.141592653589793)


def test_malformed_json_has_no_owner(spark):
    df = spark.createDataFrame([("not json", '{"operator": "x"}'), (None, None), ('{"owner_name": ""}', '{"owner": "y"}')], "a string, b string")
    assert [r[0] for r in df.select(f.owner(F.col("a"), F.col("b"))).collect()] == ["x", None, "y"]


def test_dedupe_equals_sequential_greedy(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", "c", "d", "e", "f", "g", None]), 24 + rnd.random() * 0.01, 46 + rnd.random() * 0.01) for i in range(80)]
    kept = []

    def km(p, q):
        from math import asin, cos, radians, sin, sqrt

        h = sin(radians(q[2] - p[2]) / 2) ** 2 + cos(radians(p[2])) * cos(radians(q[2])) * sin(radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6371 * asin(sqrt(h))

    for r in rows:
        if not r[1] or not any(k[1] and (k[1] == r[1] or km(k, r) < 0.2) for k in kept):
            kept.append(r)
    got = resolve.dedupe(spark.createDataFrame(rows, "id long, name string, latitude double, longitude double"), 0.2).select("id").collect()
    assert {r[0] for r in got} == {k[0] for k in kept}


def test_snapshot_sampling(spark):
    def picked(n):
        return [r[0] for r in temporal.snapshot_sample(spark.createDataFrame([("u", i) for i in range(n)], "url string, timestamp long")).select("timestamp").orderBy("timestamp").collect()]

    assert picked(1) == [0] and picked(2) == [0, 1] and picked(5) == [0, 2, 4] and picked(9) == [0, 2, 4, 6, 8]


def test_alias_import(spark):
    row = normalised(spark.createDataFrame([("h", "24.5", "x")], "hotel_name string, lat string, odd string"), "2024-01-01").first()
    assert (row["name"], row["latitude"], row["additional_info"], row["data_source"]) == ("h", 24.5, '{"odd":"x"}', "Imported Data")


@pytest.mark.parametrize("name", ["potential_violations", "evasion_split", "temporal_patterns", "closure_opening"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0 and name in ORACLE_SQL


def test_exports_and_feed(spark, tmp_path):
    from innsight.sources import tables

    df = spark.createDataFrame([(1, "a", "x@y", 4.0), (2, "b", None, None)], "id long, name string, email string, stars double")
    tables.export_csv(df, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "s"), header=True).collect()) == [("1", "a", "x@y", "4.0"), ("2", "b", None, None)]
    tables.export_csv(df, str(tmp_path / "d"), "detailed")
    assert spark.read.csv(str(tmp_path / "d"), header=True).columns == ["email", "id", "name", "stars"]
    tables.export_csv(df, str(tmp_path / "m"), "multiple")
    assert "name" in spark.read.csv(str(tmp_path / "m/basic"), header=True).columns and "email" in spark.read.csv(str(tmp_path / "m/contact"), header=True).columns
    tables.export_json(df, str(tmp_path / "j"), ["id", "stars"])
    assert sorted((r["id"], r["stars"]) for r in spark.read.json(str(tmp_path / "j")).collect()) == [(1, 4.0), (2, None)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
