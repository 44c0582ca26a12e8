"""Readers, the column-alias normaliser and writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .excel import SHEETS, read_excel

# fixed values: field and the names that files give it, the first at hand wins
ALIASES = {
    "name": ("name", "hotel_name", "title", "property_name"), "address": ("address", "location", "full_address", "street_address"), "city": ("city", "town"), "country": ("country",),
    "latitude": ("latitude", "lat"), "longitude": ("longitude", "lng", "lon"), "phone": ("phone", "telephone", "phone_number"), "email": ("email", "mail"), "website": ("website", "url", "web"),
    "stars": ("stars", "rating", "star_rating"), "price_range": ("price_range", "price"), "facilities": ("facilities", "amenities"), "legal_status": ("legal_status", "status"), "data_source": ("data_source", "source"),
}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON (records or an array), Excel or Parquet by the extension."""
    kind = os.path.splitext(path)[1].lower()
    if kind == ".csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind == ".json":
        return spark.read.json(path, multiLine=True)
    if kind == ".xlsx":
        return read_excel(spark, path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for files like {path!r}")


def normalised(df: DataFrame, as_of: str) -> DataFrame:
    """The registry's fields from whatever aliases df has; other columns go into additional_info as JSON."""
    low = {c.lower(): c for c in df.columns}
    used, out = set(), {}
    for field, names in ALIASES.items():
        own = next((low[n] for n in names if n in low), None)
        used.add(own)
        kind = "double" if field in ("latitude", "longitude", "stars") else "string"
        out[field] = F.col(own).try_cast(kind) if own else F.lit("Imported Data" if field == "data_source" else None).cast(kind)
    rest = [c for c in df.columns if c not in used]
    info = F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")
    return df.select(*[c.alias(f) for f, c in out.items()], info.alias("additional_info"), F.lit(as_of).cast("timestamp_ntz").alias("last_updated"))


def federated(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one, each row with its source's name where it has none."""
    out = None
    for name, df in sources.items():
        own = df if "data_source" in df.columns else df.withColumn("data_source", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def export_csv(df: DataFrame, path: str, kind: str = "simple") -> None:
    """A CSV folder with a header: simple (the columns as they are), detailed (all by name), or multiple, a folder each of basic and contact columns."""
    if kind == "multiple":
        for name in ("Basic Info", "Contact Info"):
            df.select([c for c in SHEETS[name] if c in df.columns]).write.mode("overwrite").csv(f"{path.rstrip('/')}/{name.split()[0].lower()}", header=True)
    else:
        (df.select(*sorted(df.columns)) if kind == "detailed" else df).write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    """A folder of JSON lines, of the fields named or of all."""
    (df.select(*fields) if fields else df).write.mode("overwrite").json(path)
