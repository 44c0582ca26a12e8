"""Cards of captured result pages: a page is cut where its repeated container begins, and each piece gives one row of fields, by column functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def plain(html: Column) -> Column:
    """Text without tags, common entities resolved, runs of blanks as one; null where nothing is left."""
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def _first(html: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def _attribute(html: Column, tag: str, name: str) -> Column:
    return F.replace(_first(html, rf'(?is)^.*?<{tag}\b[^>]*?\b{name}\s*=\s*"([^"]*)"', rf"(?is)^.*?<{tag}\b[^>]*?\b{name}\s*=\s*'([^']*)'"), F.lit("&amp;"), F.lit("&"))


def marked(html: Column, tag: str, attribute: str) -> Column:
    """The text of the first such element with an attribute (as it is written), up to where the element closes."""
    return plain(_first(html, rf"(?is)<{tag}\b[^>]*{attribute}[^>]*>(.*?)</{tag}>"))


def records(pages: DataFrame, container: str, html: str = "html", within: str | None = None) -> DataFrame:
    """pages without html, and place and card: one row for each piece that begins with a match of `container`, numbered from 0; a page without any has none. within: a pattern after which cards begin at all."""
    whole = F.col(html) if within is None else F.when(F.col(html).rlike(within), F.regexp_replace(html, rf"(?s)^.*?{within}", ""))
    pieces = F.split(F.regexp_replace(whole, f"({container})", "\u0001$1"), "\u0001", -1)
    cards = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(cards).alias("place", "card"))


def coordinates(url: Column) -> tuple[Column, Column]:
    """Latitude and longitude in an address: after @, or after ;center= as booking sites write it."""
    at, centre = rf"@{_NUMBER},{_NUMBER}", rf"[;?&]center={_NUMBER},{_NUMBER}"
    return tuple(F.coalesce(*[F.nullif(F.regexp_extract(url, p, g), F.lit("")) for p in (at, centre)]).try_cast("double") for g in (1, 2))


def map_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a place of captured map results: the links inside the feed, each with heading, rating (the first word of its image's label), count of reviews, category, address, place_id and coordinates."""
    cards = records(pages, r"(?i)<a\b[^>]*href=", html, r"""role=["']feed["'][^>]*>""")
    card = F.col("card")
    url = _attribute(card, "a", "href")
    rows = cards.withColumn("url", url).withColumn("name", marked(card, "div", r"""role=["']heading["']"""))
    lat, lon = coordinates(F.col("url"))
    fields = {
        "rating": F.split(_first(card, r"""(?is)<span\b[^>]*role=["']img["'][^>]*aria-label=["']([^"']*)["']""", r"""(?is)<span\b[^>]*aria-label=["']([^"']*)["'][^>]*role=["']img["']"""), r"\s+")[0],
        "reviews_count": F.regexp_replace(_first(card, r"(?is)<span\b[^>]*>\s*(\([0-9.,]+\))\s*</span>"), r"[()]", ""),
        "category": plain(_first(card, r"(?is)</div>\s*<div\b[^>]*>\s*<div\b[^>]*>.*?</div>\s*<div\b[^>]*>(.*?)</div>")),
        "place_id": _first(F.col("url"), r"placeid=([^&#]+)", r"place_id=([^&#]+)"), "latitude": lat, "longitude": lon,
    }
    return rows.where("name IS NOT NULL").withColumns(fields).withColumn("source", F.lit("google_maps")).drop("card")


def booking_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a property card of captured booking results: name, address, address of the page, rating (the first line of its score), price, and coordinates where the address of the page has them."""
    cards = records(pages, r"""(?i)<div\b[^>]*data-testid=["']property-card["']""", html)
    card = F.col("card")
    test = lambda tag, name: marked(card, tag, rf"""data-testid=["']{name}["']""")
    link = F.regexp_extract(card, r"""(?is)(<a\b[^>]*data-testid=["']title-link["'][^>]*>)""", 1)
    score = _first(card, r"""(?is)<div\b[^>]*data-testid=["']review-score["'][^>]*>\s*(?:<[^>]*>\s*)*([^<\n]+)""")
    rows = cards.withColumn("url", _attribute(link, "a", "href")).withColumns({"name": test("div", "title"), "address": test("span", "address"), "rating": plain(score), "price": test("span", "price-and-discounted-price")})
    lat, lon = coordinates(F.when(F.col("url").contains("city="), F.col("url")))
    return rows.where("name IS NOT NULL").withColumns({"latitude": lat, "longitude": lon, "source": F.lit("booking.com")}).drop("card")


def link_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row an item of a list that holds a link: its text and where it leads."""
    cards = records(pages, r"(?i)<li\b", html)
    item = F.regexp_extract("card", r"(?is)^(<li\b.*?</li>)", 1)
    return cards.withColumns({"name": plain(_first(item, r"(?is)<a\b[^>]*>(.*?)</a>")), "url": _attribute(item, "a", "href")}).where("url IS NOT NULL").drop("card")
