"""Reviews, map elements and page fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import contains_any, count_in

# fixed values
KEYWORDS = {
    "ar": {
        "accommodations": ["فندق", "شقة", "غرفة", "جناح", "سرير", "نزل", "إقامة", "مبيت", "أجنحة", "مفروشة", "سكن"],
        "services": ["استقبال", "حجز", "مفتاح", "غرفة", "خدمة", "طلب", "استعلامات", "موظف", "نزيل", "ضيف", "تنظيف", "منظف", "تسجيل الوصول", "تسجيل المغادرة"],
        "amenities": ["شرشف", "منشفة", "مناشف", "وسادة", "وسائد", "سرير", "أسرة", "حمام", "دش", "مكيف", "تكييف", "ثلاجة", "تلفزيون", "تلفاز", "واي فاي", "انترنت", "مسبح", "موقف", "مواقف"],
        "activities": ["إقامة", "ليلة", "ليال", "يوم", "أيام", "سهرة", "إجازة", "عطلة", "أسبوع", "نهاية الأسبوع"],
    },
    "en": {
        "accommodations": ["hotel", "apartment", "room", "suite", "bed", "inn", "lodge", "stay", "accommodation", "furnished", "hostel", "motel", "resort"],
        "services": ["reception", "booking", "key", "room", "service", "request", "concierge", "staff", "guest", "visitor", "cleaning", "cleaner", "check-in", "check-out", "checkout", "reservation"],
        "amenities": ["sheet", "towel", "pillow", "bed", "beds", "bathroom", "shower", "ac", "air conditioning", "fridge", "tv", "television", "wifi", "internet", "pool", "parking"],
        "activities": ["stay", "night", "nights", "day", "days", "evening", "vacation", "holiday", "week", "weekend"],
    },
}
LODGING = ["hotel", "hostel", "motel", "inn", "lodge", "resort", "accommodation", "فندق", "نزل", "فنادق", "أجنحة فندقية", "شقق فندقية"]
PHRASES = [
    "الغرفة", "الغرف", "النزيل", "النزلاء", "الاستقبال", "المفتاح", "السرير", "الأسرة", "الفندق", "الإقامة", "الحجز", "شقة", "مفروشة",
    "يومي", "الليلة", "ليالي", "استأجرت", "نزلت", "الوسائد", "المناشف", "الشراشف", "الحمام", "جناح", "غرفة نوم", "الإفطار", "الخدمة", "الاستضافة",
    "check in", "reception", "room", "rooms", "bed", "beds", "towels", "breakfast", "stay", "suite", "hotel", "apartment", "night", "booking",
]
OTHER_PHRASES = ["طلبت", "الطعام", "الوجبة", "المنيو", "الأكل", "تسوق", "اشتريت", "ordered", "food", "meal", "menu", "purchased", "bought", "shopping"]
NAME_WORDS = ["فندق", "شقق", "أجنحة", "نزل", "غرف", "للإيجار اليومي", "مفروشة", "hotel", "apartments", "suites", "rooms", "inn", "furnished", "daily"]
CATEGORIES = ["فندق", "شقق مفروشة", "سكن", "إقامة", "شقق فندقية", "hotel", "lodging", "accommodation", "apartment"]

#: Words, those with inner hyphens whole.
WORD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"


def language(text: Column) -> Column:
    """'ar' where Arabic letters outnumber Latin ones, else 'en'."""
    arabic = F.regexp_count(text, F.lit(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"))
    return F.when(arabic > F.regexp_count(text, F.lit("[a-zA-Z]")), "ar").otherwise("en")


def _letters(reviews: DataFrame, **sums: Column) -> DataFrame:
    """(place_id, language, reviews, words) of each place, by the letters of all its reviews, and further sums."""
    arabic = F.regexp_count("review", F.lit(r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"))
    n = F.when(F.trim("review") == "", 0).otherwise(F.size(F.split(F.trim("review"), r"\s+")))
    g = reviews.groupBy("place_id").agg(F.sum(arabic).alias("a"), F.sum(F.regexp_count("review", F.lit("[a-zA-Z]"))).alias("l"), F.count("*").alias("reviews"), F.sum(n).alias("words"), *[v.alias(k) for k, v in sums.items()])
    return g.select("place_id", F.when(F.col("a") > F.col("l"), "ar").otherwise("en").alias("language"), "reviews", "words", *sums)


def indicators(reviews: DataFrame) -> DataFrame:
    """(place_id, category, word, n): words of reviews that hint at lodging, of the list in the language of the place's reviews; a word of two categories counts in both. The word list is a constant table."""
    table = reviews.sparkSession.createDataFrame([(k, c, w) for k, lists in KEYWORDS.items() for c, ws in lists.items() for w in ws], "language string, category string, word string")
    words = reviews.select("place_id", F.explode(F.regexp_extract_all(F.lower("review"), F.lit(WORD), 0)).alias("word"))
    n = words.join(F.broadcast(table.select("word").distinct()), "word", "left_semi").groupBy("place_id", "word").agg(F.count("*").alias("n"))
    return n.join(_letters(reviews).select("place_id", "language"), "place_id").join(F.broadcast(table), ["language", "word"]).select("place_id", "category", "word", "n")


def _among(words: Column, known: list[str]) -> Column:
    return F.filter(words, lambda w: w.isin(known))


def place_confidence(reviews: DataFrame, least_reviews: int = 3, likely: float = 0.4) -> DataFrame:
    """Per place: reviews, indicators, words and confidence: indicators over a fifth of the words (10 at least), 1 at most.

    Reviews are read once: each gives its hits in the lists of every language, and the place's language picks among their sums. A null review counts as one without words.
    """
    known = sorted({w for lists in KEYWORDS.values() for ws in lists.values() for w in ws})
    said = reviews.select("place_id", "review", _among(F.regexp_extract_all(F.lower("review"), F.lit(WORD), 0), known).alias("said"))
    hits = {k: reduce(lambda a, b: a + b, [F.size(_among(F.col("said"), ws)) for ws in lists.values()]) for k, lists in KEYWORDS.items()}
    g = _letters(said, **{k: F.sum(n) for k, n in hits.items()}).where(F.col("reviews") >= least_reviews)
    own = F.coalesce(*[F.when(F.col("language") == k, F.col(k)) for k in KEYWORDS], F.lit(0)).cast("long")
    c = F.least(F.lit(1.0), F.col("indicators") / F.greatest(F.lit(10.0), F.col("words") / 5))
    return g.select("place_id", "reviews", "words", own.alias("indicators")).withColumn("confidence", c).withColumn("likely", F.col("confidence") >= likely)


def hidden_hotels(places: DataFrame, reviews: DataFrame, least_reviews: int = 3, likely: float = 0.4) -> DataFrame:
    """Places that neither by name nor by category say that they are lodging, but by least_reviews reviews or more are likely to be; surest first. A null says nothing."""
    open_ = places.where(~contains_any(F.col("name"), LODGING) & ~contains_any(F.col("category"), LODGING))
    sure = place_confidence(reviews, least_reviews, likely).where("likely").select("place_id", "confidence", "reviews")
    return open_.join(sure, "place_id").orderBy(F.desc("confidence"), "place_id")


def potential_hotel(name: Column, category: Column) -> Column:
    """Whether the category or the name has a word of lodging."""
    return contains_any(category, CATEGORIES) | contains_any(name, NAME_WORDS)


def _total(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [count_in(text, p) for p in phrases])


def _n_words(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def indicator_score(text: Column) -> Column:
    """Hits per hundred words of the phrases less those of other trades, over ten, from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 100.0 * (_total(text, PHRASES) - _total(text, OTHER_PHRASES)) / F.greatest(_n_words(text), F.lit(1)) / 10))


def indicator_ranking(reviews: DataFrame, top: int = 10) -> DataFrame:
    """(place_id, rank, phrase, occurrences, score): the phrases found most in a place's reviews, ties in the list's order; score: all hits over a tenth of the words, 1 at most."""
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("phrase"), count_in(F.col("review"), p).cast("long").alias("n")) for i, p in enumerate(PHRASES)])
    flat = reviews.select("place_id", F.explode(F.filter(own, lambda x: x["n"] > 0)).alias("x")).groupBy("place_id", "x.i", "x.phrase").agg(F.sum("x.n").alias("occurrences"))
    whole, w = Window.partitionBy("place_id"), Window.partitionBy("place_id").orderBy(F.desc("occurrences"), "i")
    ranked = flat.withColumns({"rank": F.row_number().over(w), "all": F.sum("occurrences").over(whole)}).where(F.col("rank") <= top)
    n = _letters(reviews).select("place_id", "words")
    return ranked.join(n, "place_id").select("place_id", "rank", "phrase", "occurrences", F.least(F.lit(1.0), F.col("all") / F.greatest(F.lit(1.0), F.col("words") / 10)).alias("score"))


def page_fields(html: Column) -> dict[str, Column]:
    """Fields of a captured page, the first that is found of each, else null: title, e-mail, phone, address, rating, stars, facilities, owner."""
    first = lambda *ps: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(html, p, g)), F.lit("")) for p, g in ps])
    return {
        "title": first((r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "email": first((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)),
        "phone": first((r"\+[0-9][0-9 -]{7,14}[0-9]", 0)),
        "address": first((r"(?is)<address[^>]*>([^<]+)</address>", 1), (r"(?i)address:\s*([^<\n]{5,100})", 1)),
        "stars": first((r"(?i)([1-5])[ -]?stars?\b", 1), (r"(?i)rating:\s*([0-9](?:\.[0-9])?)", 1), (r"([0-9](?:\.[0-9])?)\s*/\s*(?:5|10)\b", 1)),
        "facilities": first((r"(?i)(?:facilities|amenities):\s*([^<\n]{3,200})", 1)),
        "owner": first((r"(?i)(?:owned|operated|managed) by\s+([^<.\n]{2,80})", 1), (r"(?i)owner:\s*([^<\n]{2,80})", 1)),
    }
