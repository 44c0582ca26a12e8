"""Change histories: classes, patterns, searches, transitions, coincidences, permits, reports, snapshots, change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import contains_any, digits, likeness, owner, present
from .graphs import checkpointed
from .search import nearby

# fixed values
CLASSES = (("name", "name"), ("owner", "owner"), ("status", "status"), ("listing|platform", "platform"), ("location|address", "location"))
OFFICIAL, PRIVATE = r"booking\.com|expedia|tripadvisor", "airbnb|private|rental"
REPORT_TYPES = ("name", "owner", "status", "license", "platform")
PERMIT_WORDS = ["permit", "license", "classification", "approval", "certificate"]
DOWNGRADES = {"hotel": ("motel", "guesthouse", "residence", "apartment"), "commercial": ("residential",)}


def event_class(kind: Column) -> Column:
    """The first class whose word the event type contains, else 'other'."""
    kind, out = F.lower(kind), F.lit("other")
    for pattern, name in reversed(CLASSES):
        out = F.when(kind.rlike(pattern), name).otherwise(out)
    return out


def classified(history: DataFrame) -> DataFrame:
    return history.withColumn("class", event_class(F.col("event_type")))


def class_counts(history: DataFrame) -> DataFrame:
    return classified(history).groupBy("hotel_id", "class").agg(F.count("*").alias("n"), F.min("event_date").alias("first"), F.max("event_date").alias("last"))


def history_analysis(history: DataFrame) -> DataFrame:
    """Per hotel: events of each class, first and last, score of its temporal patterns (high 3, medium 2, low 1) and level."""
    n = classified(history).groupBy("hotel_id").agg(F.count("*").alias("events"), *[F.count_if(F.col("class") == c).alias(c) for c in ("name", "owner", "status", "platform", "location", "other")])
    points = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    s = temporal_patterns(history).groupBy("hotel_id").agg(F.sum(points * F.col("n")).alias("score"))
    return n.join(s, "hotel_id", "left").fillna(0, ["score"]).withColumn("level", F.when(F.col("score") >= 5, "high").when(F.col("score") >= 2, "medium").otherwise("low"))


def timeline(history: DataFrame) -> DataFrame:
    """Events of each hotel in order of their dates, those without one first, with their place and the side of the line where a chart shows them."""
    w = Window.partitionBy("hotel_id").orderBy(F.asc_nulls_first("event_date"), "history_id")
    i = F.row_number().over(w) - 1
    return classified(history).withColumn("place", i).withColumn("side", F.when(F.col("place") % 2 == 0, "left").otherwise("right"))


def change_examples(history: DataFrame, types=REPORT_TYPES, top: int = 5) -> DataFrame:
    """(type, rank, hotel_id, history_id): the latest `top` changes of each type of the report."""
    kind, out = F.lower("event_type"), F.lit(None).cast("string")
    for t in reversed(types):
        out = F.when(kind.contains(t), t).otherwise(out)
    w = Window.partitionBy("type").orderBy(F.desc("event_date"), F.desc("history_id"))
    return history.withColumn("type", out).where("type IS NOT NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("type", "rank", "hotel_id", "history_id")


def findings_json(history: DataFrame, transitions: DataFrame, as_of: str) -> DataFrame:
    """(hotel_id, temporal_data): what the history of a hotel shows, as the JSON text that the registry keeps."""
    a = history_analysis(history).select("hotel_id", F.struct("events", "name", "owner", "status", "platform", "location", "score", "level").alias("history"))
    t = transitions.groupBy("hotel_id").agg(F.array_sort(F.collect_list(F.struct("date", "was", "now"))).alias("transitions"))
    return a.join(t, "hotel_id", "left").select("hotel_id", F.to_json(F.struct("history", "transitions", F.lit(as_of).alias("as_of"))).alias("temporal_data"))


def temporal_patterns(history: DataFrame) -> DataFrame:
    """(hotel_id, pattern, severity, n): quick successions of names and owners, status downgrades, turns from official to private platforms, moves after a change of owner, new names near a new status.

    One shuffle: a hotel's events are sorted forth and back, and its patterns are one aggregation. All frames run along the sort, so a busy hotel costs no more than its sort.
    """
    kind, low = F.lower("event_type"), lambda c: F.lower(F.coalesce(c, F.lit("")))
    is_name, is_owner, is_status, is_listed = kind.contains("name"), kind.contains("owner"), kind.contains("status"), kind.rlike("listing|platform")
    turn = F.lit(False)
    for a, b in (("hotel", "private"), ("hotel", "residential"), ("commercial", "residential")):
        turn = turn | (low("old_value").contains(a) & low("new_value").contains(b))
    h = history.select("hotel_id", "history_id", "event_date", F.to_date("event_date").alias("day"), is_name.alias("name"), is_owner.alias("owner"), kind.rlike("location|address").alias("move"), is_status.alias("status"), (is_status & turn).alias("down"), is_listed.alias("listed"), low("new_value").rlike(OFFICIAL).alias("official"), low("new_value").rlike(PRIVATE).alias("private"))
    forth = Window.partitionBy("hotel_id").orderBy("event_date", "history_id")
    back = Window.partitionBy("hotel_id").orderBy(F.desc("event_date"), F.desc("history_id"))
    was = F.last(F.when(F.col("listed"), F.col("official")), ignorenulls=True).over(forth.rowsBetween(Window.unboundedPreceding, -1))
    # the nearest days with a new status before and after each event
    status = F.last(F.when(F.col("status"), F.col("day")), ignorenulls=True)
    h = h.withColumns({"was": was, "before": status.over(forth.rowsBetween(Window.unboundedPreceding, 0))}).withColumn("after", status.over(back.rowsBetween(Window.unboundedPreceding, 0)))
    close = (F.datediff("day", "before") < 30) | (F.datediff("after", "day") < 30)
    of = lambda k, c: F.when(F.col(k), F.col(c))
    g = h.groupBy("hotel_id").agg(
        *[F.count_if(k).alias(f"{k}_n") for k in ("name", "owner")],
        *[F.datediff(F.max(of(k, "day")), F.min(of(k, "day"))).alias(f"{k}_days") for k in ("name", "owner")],
        F.max(of("owner", "event_date")).alias("owned"), F.max(of("move", "event_date")).alias("moved"), F.count_if("down").alias("down"),
        F.count_if(F.col("listed") & F.col("was") & F.col("private")).alias("private"), F.count_if(F.col("name") & close).alias("close"),
    )
    found = lambda test, name, severity, n=None: F.when(test, F.struct(F.lit(name).alias("pattern"), severity.alias("severity"), (F.lit(1) if n is None else F.col(n)).cast("long").alias("n")))
    high, medium = F.lit("high"), F.lit("medium")
    quick = [found((F.col(f"{k}_n") >= 2) & (F.col(f"{k}_days") < 730), f"quick_{k}_changes", F.when(F.col(f"{k}_days") < 365, high).otherwise(medium)) for k in ("name", "owner")]
    counted = [found(F.col(c) > 0, name, high, c) for c, name in (("down", "status_downgrade"), ("private", "official_to_private"), ("close", "name_with_status"))]
    return g.select("hotel_id", F.inline(F.array_compact(F.array(*quick, *counted, found(F.col("moved") > F.col("owned"), "move_after_owner", medium)))))


def historical_search(history: DataFrame, kind: str | None = None, date_from: str | None = None, date_to: str | None = None, source: str | None = None, same_record: bool = False) -> DataFrame:
    """(hotel_id, events) of hotels for which each criterion holds in some record; same_record: all in one."""
    tests = []
    if kind:
        tests.append(F.lower("event_type").contains(kind.lower()))
    if date_from or date_to:
        day = F.to_date("event_date")
        tests.append((day >= F.lit(date_from or "0001-01-01").cast("date")) & (day <= F.lit(date_to or "9999-12-31").cast("date")))
    if source:
        tests.append(F.lower("source").contains(source.lower()))
    if same_record and tests:
        whole = tests[0]
        for t in tests[1:]:
            whole = whole & t
        tests = [whole]
    g = history.groupBy("hotel_id").agg(F.count("*").alias("events"), *[F.bool_or(t).alias(f"t{i}") for i, t in enumerate(tests)])
    for i in range(len(tests)):
        g = g.where(F.col(f"t{i}"))
    return g.select("hotel_id", "events")


def owner_changes(history: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    from datetime import date, timedelta

    return historical_search(history, "ownership", (date.fromisoformat(as_of) - timedelta(days=days)).isoformat())


def platform_transitions(listings: DataFrame, platforms: DataFrame, history: DataFrame, as_of: str, days: int = 3 * 365, archive: DataFrame | None = None) -> DataFrame:
    """(hotel_id, date, was, now, source) of changes of platform in the days before as_of: events about listings or platforms, neighbouring listings of a hotel by the date they were first seen
    (one of the two dates in the range; also on one platform), and what an archive (hotel_id, date, was, now) has."""
    low, high = F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")
    inside = lambda c: F.to_date(c).between(low, high)
    told = history.where(contains_any(F.col("event_type"), ["listing", "platform"]) & inside("event_date"))
    out = told.select("hotel_id", F.col("event_date").alias("date"), F.col("old_value").alias("was"), F.col("new_value").alias("now"), F.coalesce("source", F.lit("Database History")).alias("source"))
    j = listings.join(platforms.select(F.col("id").alias("platform_id"), "platform_name"), "platform_id", "left")
    name = F.coalesce("platform_name", F.col("platform_id").cast("string"))
    w = Window.partitionBy("hotel_id").orderBy("first_seen_date", "listing_id")
    pairs = j.select("hotel_id", F.col("first_seen_date").alias("d"), name.alias("was"), F.lead(name).over(w).alias("now"), F.lead("first_seen_date").over(w).alias("date")).where("now IS NOT NULL")
    out = out.unionByName(pairs.where(inside("d") | inside("date")).select("hotel_id", "date", "was", "now", F.lit("Listing Timeline").alias("source")))
    if archive is not None:
        out = out.unionByName(archive.where(inside("date")).select("hotel_id", "date", "was", "now", F.lit("Archive").alias("source")))
    return out


def same_day_events(history: DataFrame) -> DataFrame:
    day = F.to_date("event_date").cast("string").alias("day")
    return history.groupBy(day).agg(F.countDistinct("hotel_id").alias("hotels"), F.count("*").alias("events")).where("hotels >= 2")


def _tasks(left: DataFrame, right: DataFrame, keys: list[str], per_task: int = 2_000_000) -> int:
    """How many partitions leave about per_task pairs of left and right, joined by keys, to each."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count("*").cast("double").alias(c))
    pairs = n(left, "n").join(n(right, "m"), keys).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    return max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(pairs / per_task), 20_000))


def close_events(timeline: DataFrame, days: int = 30, per_task: int = 4_000_000) -> DataFrame:
    """(event_type, a, b, n): pairs of events of one type at different hotels at most `days` apart, each pair of hotels once, a < b. timeline: the events of a few hotels, as of compared() or near_place().

    Two hotels meet where a bucket of days of one is beside one of the other, with all their days of the type. The first meeting that has close events counts them all, so pairs are neither
    sent nor summed: what is sent is a row for each hotel, type and bucket. The hotels of a bucket are cut into slices, and only slices meet, about per_task pairs a task.
    """
    day = F.unix_date(F.to_date("event_date"))
    e = timeline.select("hotel_id", "event_type", day.alias("day")).where("day IS NOT NULL AND event_type IS NOT NULL AND hotel_id IS NOT NULL")
    e = e.groupBy("hotel_id", "event_type", "day").agg(F.count("*").alias("k")).withColumn("bucket", F.floor(F.col("day") / days))
    h = checkpointed(e.groupBy("hotel_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("day", "k"))).alias("all"), F.collect_set("bucket").alias("buckets")))
    a = h.select("event_type", F.explode("buckets").alias("bucket"), F.col("hotel_id").alias("a"), F.col("all").alias("x"))
    around = F.array_distinct(F.flatten(F.transform("buckets", lambda k: F.array(k - 1, k, k + 1))))
    b = h.select("event_type", F.explode(around).alias("bucket"), F.col("hotel_id").alias("b"), F.col("all").alias("y"))
    keys = ["event_type", "bucket"]
    tasks = _tasks(a, b, keys, per_task)
    most = a.groupBy(keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = max(1, round((3 * most**2 / per_task) ** 0.5))
    slice_, every = lambda c: F.pmod(F.xxhash64(c), F.lit(slices)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    dealt = [*keys, "i", "j"]
    met = a.withColumns({"i": slice_("a"), "j": every}).repartition(tasks, *dealt).join(b.withColumns({"j": slice_("b"), "i": every}).repartition(tasks, *dealt), dealt).where("a < b")
    near, one = f"filter(y, v -> abs(u.day - v.day) <= {days})", "WHEN size(x) = 1 AND size(y) = 1 THEN"  # of one day each, most are, no function goes over arrays
    first = F.expr(f"CASE {one} IF(abs(x[0].day - y[0].day) <= {days}, x[0].day, NULL) ELSE get(filter(x, u -> exists(y, v -> abs(u.day - v.day) <= {days})), 0).day END")  # days are sorted
    n = F.expr(f"CASE {one} x[0].k * y[0].k ELSE aggregate(x, 0L, (s, u) -> s + u.k * aggregate({near}, 0L, (t, v) -> t + v.k)) END")
    return met.where(F.floor(first / days) == F.col("bucket")).select("event_type", "a", "b", n.alias("n"))


def near_place(hotels: DataFrame, history: DataFrame, latitude: float, longitude: float, metres: float, as_of: str, days: int = 5 * 365) -> DataFrame:
    """The events of hotels at most `metres` from a place in the days before as_of, oldest first."""
    inside = nearby(hotels, latitude, longitude, metres).select(F.col("id").alias("hotel_id"))
    day = F.to_date("event_date")
    return history.where((day >= F.date_sub(F.lit(as_of).cast("date"), days)) & (day <= F.lit(as_of).cast("date"))).join(inside, "hotel_id", "left_semi").orderBy(F.asc_nulls_first("event_date"), "history_id")


def place_summary(hotels: DataFrame, history: DataFrame, latitude: float, longitude: float, metres: float, as_of: str, days: int = 5 * 365) -> DataFrame:
    """One row: hotels at a place, hotels with events, events, closures followed by openings elsewhere at the place, and whether several hotels changed."""
    events = near_place(hotels, history, latitude, longitude, metres, as_of, days)
    e = events.agg(F.countDistinct("hotel_id").alias("with_history"), F.count("*").alias("events"))
    pairs = closure_openings(events)
    n = nearby(hotels, latitude, longitude, metres).agg(F.count("*").alias("hotels"))
    return n.join(e).join(pairs).withColumn("several_changed", F.col("with_history") > 1)


def compared(history: DataFrame, first: int, second: int) -> DataFrame:
    """The events of two hotels as one timeline, oldest first."""
    return history.where(F.col("hotel_id").isin(first, second)).orderBy(F.asc_nulls_first("event_date"), "history_id")


def likenesses(hotels: DataFrame, first: int, second: int, least: float = 0.7) -> DataFrame:
    """(type, score, value1, value2) of what two hotels have alike: addresses and owners above `least`, equal phones by their digits, equal e-mails."""
    h = hotels.withColumn("owner", owner(F.col("ownership_info"), F.col("additional_info"))).select("id", "address", "phone", "email", "owner")
    a, b = (h.where(F.col("id") == i).limit(1).select([F.col(c).alias(f"{c}{k}") for c in h.columns]) for k, i in ((1, first), (2, second)))
    equal = {"phone": digits, "email": F.lower}

    def entry(c: str):
        x, y = F.col(f"{c}1"), F.col(f"{c}2")
        score = F.when(equal[c](x) == equal[c](y), 1.0).otherwise(0.0) if c in equal else likeness(x, y)
        return F.when(present(x) & present(y), F.struct(F.lit(c).alias("type"), score.alias("score"), x.alias("value1"), y.alias("value2")))

    rows = a.join(b).select(F.explode(F.array_compact(F.array(*[entry(c) for c in ("address", "phone", "email", "owner")]))).alias("x")).select("x.*")
    return rows.where(F.col("score") > least)


def _closed_opened(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed, c, i) and (opened, o, j): closures and openings of each hotel and day with their numbers."""
    kind, value, day = F.lower("event_type"), F.lower(F.coalesce("new_value", F.lit(""))), F.to_date("event_date")
    is_closed, is_opened = kind.contains("closure") | (kind.contains("status") & value.contains("closed")), kind.contains("opening") | (kind.contains("status") & value.contains("open"))
    e = checkpointed(history.where(is_closed | is_opened).groupBy("hotel_id", day.alias("day")).agg(F.count_if(is_closed).alias("i"), F.count_if(is_opened).alias("j")))
    return e.where("i > 0").select(F.col("hotel_id").alias("closed"), F.col("day").alias("c"), "i"), e.where("j > 0").select(F.col("hotel_id").alias("opened"), F.col("day").alias("o"), "j")


def closure_opening(history: DataFrame, days: int = 180) -> DataFrame:
    """(closed, opened, n): closures followed by an opening at another hotel within days. history: the events of one place, as of near_place().

    The pairs of hotels are what the result is made of; they are dealt over as many partitions as leave a bounded number to each. For their sum alone use closure_openings().
    """
    closed, opened = _closed_opened(history)
    width = max(1, days // 6)
    c = closed.withColumn("bucket", F.floor(F.unix_date("c") / width))
    o = opened.withColumn("bucket", F.explode(F.sequence(F.floor((F.unix_date("o") - days) / width), F.floor((F.unix_date("o") - 1) / width))))
    met = c.join(o, "bucket").where("closed != opened AND o > c").where(F.datediff("o", "c") <= days).select("closed", "opened", (F.col("i") * F.col("j")).alias("n"))
    return met.repartition(_tasks(c, o, ["bucket"]), "closed", "opened").groupBy("closed", "opened").agg(F.sum("n").alias("n"))


def closure_openings(history: DataFrame, days: int = 180) -> DataFrame:
    """One row (closure_openings): the sum of closure_opening() without its pairs of hotels: by days, less those of one hotel."""
    closed, opened = _closed_opened(history)
    at = lambda df, day, n: df.where(F.col(day).isNotNull()).groupBy(day).agg(F.sum(n).alias(n))
    near = (F.col("o") > F.col("c")) & (F.datediff("o", "c") <= days)
    ahead = at(closed, "c", "i").withColumn("o", F.explode(F.expr(f"sequence(date_add(c, 1), date_add(c, {days}))")))
    all_ = ahead.join(at(opened, "o", "j"), "o").agg(F.sum(F.col("i") * F.col("j")).alias("n"))
    own = closed.join(opened, (F.col("closed") == F.col("opened")) & near).agg(F.sum(F.col("i") * F.col("j")).alias("m"))
    return all_.join(own).select((F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).cast("long").alias("closure_openings"))


def stars_in(text: Column) -> Column:
    return F.expr("try_cast(regexp_extract(coalesce({0}, ''), '([0-9])', 1) AS int)".format(text))


def permits(history: DataFrame) -> DataFrame:
    """Per hotel: permit events, classification changes within a year of each other, star downgrades, type downgrades, score and level."""
    text = F.concat_ws(" ", "event_type", "notes")
    kind = F.lower("event_type")
    old, new = F.lower(F.coalesce("old_value", F.lit(""))), F.lower(F.coalesce("new_value", F.lit("")))
    down = F.lit(False)
    for a, to in DOWNGRADES.items():
        down = down | (old.contains(a) & new.rlike("|".join(to)))
    is_class = kind.contains("classification")
    g = history.where(contains_any(text, PERMIT_WORDS)).groupBy("hotel_id").agg(
        F.count("*").alias("events"), F.count_if(is_class).alias("classes"), F.datediff(F.max(F.when(is_class, F.to_date("event_date"))), F.min(F.when(is_class, F.to_date("event_date")))).alias("span"),
        F.count_if(is_class & (stars_in("new_value") < stars_in("old_value"))).alias("star_downgrades"), F.count_if(is_class & down).alias("type_downgrades"),
    )
    score = F.when((F.col("classes") >= 2) & (F.col("span") <= 365), 3).otherwise(0) + 2 * F.col("star_downgrades") + 3 * F.col("type_downgrades")
    return g.withColumn("score", score.cast("long")).withColumn("level", F.when(F.col("score") >= 3, "high").when(F.col("score") >= 1, "medium").otherwise("low")).drop("span")


def change_report(history: DataFrame, types=REPORT_TYPES) -> DataFrame:
    """(type, changes, hotels): each change under the first type that its event type contains."""
    kind, out = F.lower("event_type"), F.lit(None).cast("string")
    for t in reversed(types):
        out = F.when(kind.contains(t), t).otherwise(out)
    return history.withColumn("type", out).where("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("changes"), F.countDistinct("hotel_id").alias("hotels"))


def change_summary(history: DataFrame, hotels: DataFrame, as_of: str, days: int = 365, least: int = 1, types=REPORT_TYPES) -> DataFrame:
    """One row: hotels at all, hotels with `least` changes of the report's types or more in the days before as_of, changes of these types, and changes a hotel with changes to two decimals."""
    kind = F.lower("event_type")
    recent = history.where((F.to_date("event_date") >= F.date_sub(F.lit(as_of).cast("date"), days)) & contains_any(kind, list(types)))
    per = recent.join(hotels.select(F.col("id").alias("hotel_id")), "hotel_id", "left_semi").groupBy("hotel_id").agg(F.count("*").alias("n"))
    g = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_changes"), F.count_if(F.col("n") >= least).alias("hotels_with_changes"))
    average = F.when(F.col("hotels_with_changes") > 0, F.round(F.col("total_changes") / F.col("hotels_with_changes"), 2)).otherwise(0.0)
    return hotels.agg(F.count("*").alias("total_hotels")).join(g).select("total_hotels", "hotels_with_changes", "total_changes", average.alias("average"))  # one row each


def change_buckets(history: DataFrame) -> DataFrame:
    n = history.groupBy("hotel_id").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") >= 10, "10+").otherwise(F.col("n").cast("string")).alias("bucket")).agg(F.count("*").alias("hotels"))


def captures(index: DataFrame) -> DataFrame:
    """(url, timestamp, digest, archive_path) of an archive's index with columns url, timestamp (14 digits), original, statuscode and digest: good ones alone, of adjacent equal digests the first.
    Captures of one second stand as an index sorts its lines: by original, then by digest."""
    w = Window.partitionBy("url").orderBy("timestamp", "original", "digest")
    good = index.where(F.col("statuscode").cast("string") == "200").withColumn("_was", F.lag("digest").over(w))
    return good.where(~F.col("digest").eqNullSafe(F.col("_was"))).select("url", "timestamp", F.try_to_timestamp("timestamp", F.lit("yyyyMMddHHmmss")).alias("date"), "digest", F.concat_ws("/", F.lit("web"), "timestamp", "original").alias("archive_path"))


def snapshot_sample(snapshots: DataFrame, key: str = "url", order: str = "timestamp") -> DataFrame:
    """Of each key's snapshots: all of two, first, middle and last of up to five, else first, last and each quarter from the first quarter on."""
    i, n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1, F.count("*").over(Window.partitionBy(key))
    s = snapshots.withColumns({"_i": i, "_n": n})
    step = F.expr("_n div 4")
    few = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("_i") == F.expr("_n div 2"))
    many = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | ((F.col("_i") >= step) & (F.col("_i") < F.col("_n") - 1) & (F.col("_i") % F.greatest(step, F.lit(1)) == 0))
    return s.where((F.col("_n") <= 2) | F.when(F.col("_n") <= 5, few).otherwise(many)).drop("_i", "_n")


def snapshot_diff(snapshots: DataFrame, fields: list[str], key: str = "url", order: str = "timestamp") -> DataFrame:
    """(key, order, field, old, new) where a field differs from the snapshot before, nulls told apart."""
    w = Window.partitionBy(key).orderBy(order)
    s = snapshots.select(key, order, F.row_number().over(w).alias("_k"), *[F.struct(F.lag(f).over(w).cast("string").alias("old"), F.col(f).cast("string").alias("new")).alias(f) for f in fields]).where("_k > 1")
    flat = s.select(key, order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f)["old"].alias("old"), F.col(f)["new"].alias("new")) for f in fields])).alias("x")).select(key, order, "x.*")
    return flat.where(~F.col("old").eqNullSafe(F.col("new")))


def capture_changes(old: DataFrame, new: DataFrame, key: str = "id", fields: list[str] | None = None, skip=("last_updated",)) -> DataFrame:
    """(key, event_type, old_value, new_value, source) for each field of both versions that differs."""
    fields = fields or [c for c in new.columns if c in old.columns and c != key and c not in skip]
    a, b = old.select(key, *[F.col(c).cast("string").alias(f"o_{c}") for c in fields]), new.select(key, *[F.col(c).cast("string").alias(f"n_{c}") for c in fields])
    pairs = F.array(*[F.struct(F.lit(f"{c}_change").alias("event_type"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value")) for c in fields])
    return a.join(b, key).select(key, F.explode(pairs).alias("x")).select(key, "x.*", F.lit("auto_update").alias("source")).where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def upsert(base: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """base with the rows of fresh in place of those of the same key."""
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
