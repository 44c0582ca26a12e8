"""HTML reports of small results: a map, violations, a timeline. Texts are escaped; rows come over one by one."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import present

# fixed values: factor to advice and its priority
ADVICE = {"missing_fields": ("data_collection", "medium"), "unofficial_listings": ("platform_verification", "high"), "residential_location": ("zoning_check", "medium")}
COLOURS = {"high": "red", "medium": "orange", "low": "green"}


def _page(title: str, body: str) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{body}</body></html>'


def _table(df: DataFrame) -> str:
    cell = lambda v: escape("" if v is None else str(v))
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.toLocalIterator()) + "</table>"


def map_points(hotels: DataFrame) -> DataFrame:
    """id, name, place, colour by level and icon by stars of hotels with coordinates."""
    colour = F.lit("blue")
    for k, c in COLOURS.items():
        colour = F.when(F.col("risk_level") == k, c).otherwise(colour)
    icon = F.when(F.col("stars") >= 4, "star").otherwise("home")
    return hotels.where(present("latitude") & present("longitude")).select("id", F.coalesce("name", F.lit("Unknown")).alias("name"), "latitude", "longitude", colour.alias("colour"), icon.alias("icon"))


def export_map(hotels: DataFrame, path: str, title: str = "Hotels") -> None:
    """A page with the hotels' points as GeoJSON, drawn as circles in a plain SVG around their centre."""
    points = map_points(hotels)
    c = points.agg(F.avg("latitude").alias("y"), F.avg("longitude").alias("x"), F.min("latitude").alias("s"), F.max("latitude").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e")).first()
    if c["y"] is None:
        raise ValueError("no hotel has coordinates")
    high, wide = max(c["n"] - c["s"], 1e-6), max(c["e"] - c["w"], 1e-6)
    rows = list(points.orderBy("id").toLocalIterator())
    dots = "".join(f'<circle cx="{800 * (r["longitude"] - c["w"]) / wide:.1f}" cy="{600 * (c["n"] - r["latitude"]) / high:.1f}" r="4" fill="{r["colour"]}"><title>{escape(r["name"])}</title></circle>' for r in rows)
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [r["longitude"], r["latitude"]]}, "properties": {k: r[k] for k in ("id", "name", "colour", "icon")}} for r in rows]}
    data = json.dumps(shape, ensure_ascii=False).replace("<", "\\u003c")
    with open(path, "w", encoding="utf-8") as f:
        f.write(_page(title, f'<p>Centre: {c["y"]:.6f}, {c["x"]:.6f}</p><svg viewBox="-10 -10 820 620">{dots}</svg><script type="application/geo+json">{data}</script>'))


def recommendations(factors: DataFrame, levels: DataFrame, top: int = 3) -> DataFrame:
    """(factor, n, advice, priority): verification of the high-risk and the medium-risk hotels, if there are any, and what the `top` factors found most call for. factors: (factor, n); levels: one row with high and medium."""
    known = factors.sparkSession.createDataFrame([(k, *v) for k, v in ADVICE.items()], "factor string, advice string, priority string")
    own = factors.orderBy(F.desc("n"), "factor").limit(top).join(F.broadcast(known), "factor")
    general = F.array(*[F.struct(F.lit(f"{c}_risk").alias("factor"), F.col(c).alias("n"), F.lit(a).alias("advice"), F.lit(c).alias("priority")) for c, a in (("high", "immediate_verification"), ("medium", "scheduled_verification"))])
    return own.unionByName(levels.select(F.explode(general).alias("x")).select("x.*").where("n > 0"))


def export_violations(summary: DataFrame, rows: DataFrame, factors: DataFrame, path: str, title: str = "Violations") -> None:
    parts = [("Summary", summary), ("Factors", factors.orderBy(F.desc("n"), "factor")), ("Recommendations", recommendations(factors, summary)), ("Hotels", rows)]
    with open(path, "w", encoding="utf-8") as f:
        f.write(_page(title, "".join(f"<h2>{t}</h2>{_table(df)}" for t, df in parts)))


def export_timeline(events: DataFrame, path: str, title: str = "Timeline") -> None:
    """events: of operators.temporal.timeline, of few hotels."""
    rows = events.orderBy("hotel_id", "place").toLocalIterator()
    items = "".join(f'<div class="{r["side"]} {escape(r["class"])}"><b>{escape(str(r["event_date"]))}</b> {escape(str(r["event_type"]))}: {escape(str(r["old_value"]))} &rarr; {escape(str(r["new_value"]))}</div>' for r in rows)
    with open(path, "w", encoding="utf-8") as f:
        f.write(_page(title, items))
