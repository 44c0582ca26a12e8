"""Column functions: presence, similarity, distance, phones, owners and JSON fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def present(c: Column | str) -> Column:
    """Neither null nor empty, and of numbers not zero; a text of "0" is one."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")
    return F.coalesce((text != "") & ((F.typeof(c) == "string") | ~text.isin("0", "0.0", "-0.0")), F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, in lower case; two empty texts are alike, a null counts as empty."""
    a, b = (F.lower(F.coalesce(x, F.lit(""))) for x in (a, b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def likeness(a: Column, b: Column) -> Column:
    """similarity(a, b), but 0 where either is empty or null."""
    return F.when(present(a) & present(b), similarity(a, b)).otherwise(0.0)


def text_likeness(a: Column, b: Column) -> Column:
    """Trimmed and in lower case: 1 for equal texts, the ratio of lengths where one contains the other, else similarity."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    part = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), part).otherwise(similarity(x, y))


def similar_above(a: Column, b: Column, least: float) -> Column:
    """similarity(a, b) > least, without the distance where the lengths alone rule it out."""
    x, y = F.length(a), F.length(b)
    return (F.least(x, y) > least * F.greatest(x, y)) & (similarity(a, b) > least)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def geo_similarity(km: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - km / 2)


def digits(phone: Column) -> Column:
    return F.regexp_replace(phone, r"\D", "")


def phone_similarity(a: Column, b: Column) -> Column:
    return phone_likeness(digits(a), digits(b))


def phone_likeness(a: Column, b: Column) -> Column:
    """Of two phones' digits: 1 for equal ones, 0.9 and 0.7 where the last six or four of six or more are equal."""
    enough = F.least(F.length(a), F.length(b)) >= 6
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(enough & (F.right(a, F.lit(6)) == F.right(b, F.lit(6))), 0.9).when(enough & (F.right(a, F.lit(4)) == F.right(b, F.lit(4))), 0.7).otherwise(0.0)


def json_text(c: Column, key: str) -> Column:
    """A field of a JSON text; null where the text is malformed or the field is empty."""
    return F.nullif(F.get_json_object(c, f"$.{key}"), F.lit(""))


def owner(ownership: Column, additional: Column) -> Column:
    return F.coalesce(json_text(ownership, "owner_name"), *[json_text(additional, k) for k in ("owner_name", "owner", "operator")])


def has_json_key(c: Column, words: list[str]) -> Column:
    """Whether a top-level key contains one of the words and has a value."""
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    return F.coalesce(F.exists(entries, lambda e: F.lower(e["key"]).rlike("|".join(words)) & present(e["value"])), F.lit(False))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the text, in lower case, contains one of the words as they are written."""
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def level(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def count_in(text: Column, phrase: str) -> Column:
    """Occurrences of a phrase that don't overlap."""
    return F.size(F.split(F.lower(text), rf"\Q{phrase}\E", -1)) - 1
