"""Comparing JSON texts of any shape, field by field, as paths of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reviews import page_fields

# fixed values
PERMIT_KEYS = ["permit", "license", "certification"]
_MOST_DEPTH = 32


def paths(df: DataFrame, data: str, ids: list[str]) -> DataFrame:
    """(ids, path, value): the leaves of a JSON text, objects by key and arrays by number, as a.b[0]; empty objects, empty arrays and null have a row each with value null. A malformed text has none.

    One level is opened at a time, for all rows together, as many times as the deepest text has levels (32 at most, else an error).
    """
    open_ = df.select(*ids, F.lit("").alias("path"), F.try_parse_json(data).alias("v")).where("v IS NOT NULL")
    out = None
    for _ in range(_MOST_DEPTH):
        kind = F.schema_of_variant("v")
        inner = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (F.expr("to_json(v)") != "[]"))
        leaf = open_.where(~inner).select(*ids, F.regexp_replace("path", r"^\.", "").alias("path"), F.when(~kind.rlike("^(OBJECT|ARRAY|VOID)"), F.expr("try_variant_get(v, '$', 'string')")).alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        deeper = open_.where(inner)
        if deeper.isEmpty():
            return out
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        exploded = deeper.sparkSession.sql("SELECT o.*, e.pos, e.key, e.value AS inner_v FROM {o} o, LATERAL variant_explode(o.v) e", o=deeper)
        open_ = exploded.select(*ids, F.concat("path", step).alias("path"), F.col("inner_v").alias("v"))
    raise ValueError(f"texts are nested deeper than {_MOST_DEPTH} levels")


def json_diff(snapshots: DataFrame, data: str = "data", key: str = "url", order: str = "timestamp") -> DataFrame:
    """(key, order, path, old, new): where a snapshot's JSON differs from that before it of the same key, by path; a path that only one of the two has is null in the other.

    Snapshots are joined with their successors by key, number and path, so nothing is gathered. Orders are unique for a key; a malformed text counts as one without fields.
    """
    w = Window.partitionBy(key).orderBy(order)
    s = snapshots.select(key, order, data, F.row_number().over(w).alias("_k"), F.lead(order).over(w).alias("_next"))
    leaves = paths(s, data, [key, order, "_k", "_next"])
    old = leaves.where("_next IS NOT NULL").select(key, F.col("_next").alias(order), (F.col("_k") + 1).alias("_k"), "path", F.col("value").alias("old"), F.lit(True).alias("_old"))
    new = leaves.where("_k > 1").select(key, order, "_k", "path", F.col("value").alias("new"), F.lit(True).alias("_new"))
    both = old.join(new, [key, order, "_k", "path"], "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")) | F.col("_old").isNull() | F.col("_new").isNull()).where("old IS NOT NULL OR new IS NOT NULL").select(key, order, "path", "old", "new")


def page_snapshot(html: Column) -> Column:
    """A captured page's fields as nested JSON: title, contact_info and hotel_info."""
    f = {k: c for k, c in page_fields(html).items()}
    contact = F.struct(*[f[k].alias(k) for k in ("phone", "email", "address")])
    hotel = F.struct(*[f[k].alias(k) for k in ("stars", "facilities", "owner")])
    return F.to_json(F.struct(f["title"].alias("title"), contact.alias("contact_info"), hotel.alias("hotel_info")))


def snapshot_changes(snapshots: DataFrame, html: str = "html", key: str = "url", order: str = "timestamp") -> DataFrame:
    """(key, order, type, old, new): changes of a page's title, contact and hotel fields between neighbouring captures, as title_change, contact_..._change and hotel_..._change."""
    found = json_diff(snapshots.withColumn("_data", page_snapshot(F.col(html))), "_data", key, order)
    kind = F.concat(F.regexp_replace(F.regexp_replace("path", r"^contact_info\.", "contact_"), r"^hotel_info\.", "hotel_"), F.lit("_change"))
    return found.select(key, order, kind.alias("type"), "old", "new")


def listed_permits(hotels: DataFrame, data: str = "additional_info") -> DataFrame:
    """(id, type, value, source): permits that a hotel's own JSON tells of, by the names of its fields at the top; nested values as JSON."""
    info = hotels.select("id", F.try_parse_json(data).alias("v")).where("v IS NOT NULL AND startswith(schema_of_variant(v), 'OBJECT<')")
    rows = hotels.sparkSession.sql("SELECT i.id, e.key AS type, coalesce(try_variant_get(e.value, '$', 'string'), to_json(e.value)) AS value FROM {i} i, LATERAL variant_explode(i.v) e", i=info)
    return rows.where(F.lower("type").rlike("|".join(PERMIT_KEYS))).withColumn("source", F.lit("Hotel Data"))
