import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from innsight.operators import search
from innsight.sources import layout, versions

SCHEMA = "id long, name string, phone string, stars double, last_updated string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_merges_write_touched_buckets_alone(spark, tmp_path):
    path, base = str(tmp_path / "t"), [(i, f"n{i}", None if i % 3 else "1", float(i), "d0") for i in range(60)]
    versions.create(spark.createDataFrame(base, SCHEMA), path, buckets=8)
    before = set(glob.glob(f"{path}/data/*/*/*.parquet"))
    fresh = spark.createDataFrame([(3, "new name", "d1"), (4, "n4", "d1"), (100, "hundred", "d1")], "id long, name string, last_updated string")
    assert versions.merge(fresh, path) == 2
    want = {r[0]: r for r in base} | {3: (3, "new name", "1", 3.0, "d1"), 100: (100, "hundred", None, None, "d1")}
    assert rows(versions.read(spark, path)) == sorted(want.values())
    assert rows(versions.read(spark, path, 1)) == sorted(base)
    assert 1 <= len({f.split("_bucket=")[1].split("/")[0] for f in set(glob.glob(f"{path}/data/*/*/*.parquet")) - before}) <= 2
    assert {(r["id"], r["event_type"], r["old_value"], r["new_value"], r["version"]) for r in versions.history(spark, path).collect()} == {(3, "name_change", "n3", "new name", 2), (100, "created", None, None, 2)}
    files = set(glob.glob(f"{path}/**/*.parquet", recursive=True))
    assert versions.merge(fresh, path) == 2 and set(glob.glob(f"{path}/**/*.parquet", recursive=True)) == files
    more = spark.createDataFrame([(3, None)], "id long, phone string")
    assert versions.merge(more, path) == 3 and versions.history(spark, path).count() == 3
    assert versions.read(spark, path).where("id = 3").first()["phone"] is None


def test_failed_writes_leave_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.createDataFrame([(1, "a", None, None, None)], SCHEMA), path)
    broken = spark.range(1, 3).select("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.lit("b")).alias("name"))
    with pytest.raises(Exception, match="lost"):
        versions.merge(broken, path)
    assert versions.versions(spark, path) == [1] and versions.read(spark, path).first()["name"] == "a" and versions.history(spark, path) is None
    old = versions._manifest(spark, path)
    versions.merge(spark.createDataFrame([(1, "c")], "id long, name string"), path)
    with pytest.raises(RuntimeError):
        versions._commit(spark, path, old | {"version": 2})  # another writer was first
    assert versions.read(spark, path).first()["name"] == "c"
    with pytest.raises(ValueError):
        versions.create(spark.createDataFrame([], SCHEMA), path)


def test_a_search_reads_few_row_groups(spark, tmp_path):
    rnd = random.Random(2)
    points = [(i, f"h{i}", 20 + rnd.random() * 10, 40 + rnd.random() * 10) for i in range(40_000)] + [(50_000 + i, "x", 24.0 + i * 1e-4, 46.0) for i in range(20)] + [(60_000, "none", None, None)]
    df = spark.createDataFrame(points, "id long, name string, latitude double, longitude double")
    path = str(tmp_path / "points")
    layout.write_clustered(df, path, files=64, group_bytes=64 << 10)
    near = layout.around(spark, path, 24.0, 46.0, 1000)
    assert "PushedFilters: [Or(" in near._jdf.queryExecution().executedPlan().toString() or "place_key" in near._jdf.queryExecution().executedPlan().toString()
    got = rows(search.nearby(near, 24.0, 46.0, 1000).select("id"))
    assert got == rows(search.nearby(df, 24.0, 46.0, 1000).select("id")) and len(got) >= 10
    own = layout.ranges(24 - 0.009, 46 - 0.01, 24 + 0.009, 46 + 0.01)
    met = total = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            column = next(meta.row_group(g).column(c) for c in range(meta.num_columns) if meta.row_group(g).column(c).path_in_schema == "place_key")
            total += 1
            met += column.statistics.has_min_max and any(column.statistics.min <= high and low <= column.statistics.max for low, high in own)
    assert total >= 60 and met < 0.05 * total


@pytest.mark.parametrize("place", [(0.0, 179.999), (0.0, -179.999), (89.9999, 10.0), (-89.99, 0.0), (45.0, 7.0)])
def test_boxes_hold_all_that_is_near(spark, tmp_path, place):
    rnd = random.Random(1)
    wide = min(180.0, 0.02 / max(math.cos(math.radians(place[0])), 1e-6))
    points = [(i, max(-90.0, min(90.0, place[0] + rnd.uniform(-0.02, 0.02))), (place[1] + rnd.uniform(-wide, wide) + 180) % 360 - 180) for i in range(300)]
    df = spark.createDataFrame(points, "id long, latitude double, longitude double")
    layout.write_clustered(df, str(tmp_path / "p"), files=2)

    def km(p):
        a, o, b, u = map(math.radians, (*place, *p))
        return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((u - o) / 2) ** 2)))

    found = {r["id"] for r in layout.around(spark, str(tmp_path / "p"), *place, 1500).collect()}
    assert {i for i, *p in points if p[0] and p[1] and km(p) <= 1.5} <= found
