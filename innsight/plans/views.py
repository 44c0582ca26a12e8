"""Deterministic views over the driver's tables, in SQL that Spark and DuckDB share. @name stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "hotels": r"""
SELECT c.c_custkey AS id,
  p.p_name || CASE WHEN CAST((c.c_custkey - c.c_custkey % 5) / 5 AS BIGINT) % 4 = 0 THEN ' apartment ' || CAST(c.c_custkey % 5 AS VARCHAR(4))
    WHEN c.c_custkey % 5 = 0 THEN ' hotel' WHEN c.c_custkey % 5 = 1 THEN ' apartment ' || CAST(c.c_custkey % 4 AS VARCHAR(4))
    WHEN c.c_custkey % 5 = 2 THEN ' residence' WHEN c.c_custkey % 5 = 3 THEN ' hotel apartment' ELSE ' inn' END AS name,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE p.p_brand || ' street ' || CAST(p.p_size AS VARCHAR(4)) END AS address,
  n.n_name AS city, r.r_name AS country,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE CAST(24.0 AS DOUBLE) + (CAST((c.c_custkey - c.c_custkey % 5) / 5 AS BIGINT) % 97) * CAST(0.0007 AS DOUBLE) + (c.c_custkey % 5) * CAST(0.0001 AS DOUBLE) END AS latitude,
  CASE WHEN c.c_acctbal < 0 THEN NULL ELSE CAST(46.0 AS DOUBLE) + (CAST((c.c_custkey - c.c_custkey % 5) / 5 AS BIGINT) % 89) * CAST(0.0009 AS DOUBLE) + (c.c_custkey % 3) * CAST(0.0002 AS DOUBLE) END AS longitude,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE '+966-11-' || CAST(1000000 + (c.c_custkey % 500) AS VARCHAR(8)) END AS phone,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL WHEN c.c_custkey % 4 = 1 THEN '' ELSE 'info' || CAST(c.c_custkey AS VARCHAR(12)) || '@example.com' END AS email,
  CASE WHEN c.c_custkey % 5 < 2 THEN NULL ELSE 'http://h' || CAST(c.c_custkey AS VARCHAR(12)) || '.example.com' END AS website,
  CASE WHEN c.c_custkey % 7 = 0 THEN NULL ELSE CAST(p.p_size % 5 + 1 AS DOUBLE) END AS stars,
  CASE WHEN c.c_mktsegment IN ('BUILDING','MACHINERY') THEN 'low' WHEN c.c_mktsegment = 'FURNITURE' THEN 'mid' ELSE 'high' END AS price_range,
  CASE WHEN p.p_size % 4 = 0 THEN NULL WHEN p.p_size % 4 = 1 THEN 'Restaurant, Pool' WHEN p.p_size % 4 = 2 THEN 'Restaurant, Pool, Gym, Room Service' ELSE 'Parking' END AS facilities,
  CASE WHEN c.c_custkey % 6 = 0 THEN 'Hotel license' WHEN c.c_custkey % 6 = 1 THEN 'Residential' WHEN c.c_custkey % 6 = 2 THEN 'registered' WHEN c.c_custkey % 6 = 3 THEN 'apartment' ELSE NULL END AS legal_status,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'Google Places' WHEN c.c_custkey % 3 = 1 THEN 'OpenStreetMap' ELSE 'Imported Data' END AS data_source,
  CASE WHEN c.c_custkey % 10 = 0 THEN 'inactive' ELSE 'active' END AS operation_status,
  CASE WHEN c.c_custkey % 4 = 0 THEN 'verified' WHEN c.c_custkey % 4 = 1 THEN 'unverified' ELSE 'pending' END AS verification_status,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE TIMESTAMP '2023-12-01 00:00:00' + (c.c_custkey % 62) * INTERVAL '1' DAY END AS last_verification_date,
  TIMESTAMP '2023-11-01 00:00:00' + (c.c_custkey % 92) * INTERVAL '1' DAY AS last_updated,
  CASE WHEN c.c_custkey % 8 = 0 THEN CAST(c.c_custkey % 10 AS DOUBLE) ELSE NULL END AS risk_score,
  CASE WHEN c.c_custkey % 13 = 0 THEN 'residential' WHEN c.c_custkey % 13 = 1 THEN 'commercial' ELSE NULL END AS area_type,
  CASE WHEN c.c_custkey % 4 = 0 THEN '{"owner_name": "' || s.s_name || '"}' WHEN c.c_custkey % 4 = 1 THEN 'not json' ELSE NULL END AS ownership_info,
  CASE WHEN c.c_custkey % 4 = 2 THEN '{"operator": "' || s.s_name || '", "min stay": "' || CAST(1 + c.c_custkey % 14 AS VARCHAR(4)) || ' nights"}'
    WHEN c.c_custkey % 12 = 3 THEN '{"license_no": "L' || CAST(c.c_custkey AS VARCHAR(12)) || '", "zone_type": "residential"}' ELSE NULL END AS additional_info
FROM @customer c JOIN @part p ON p.p_partkey = c.c_custkey - c.c_custkey % 5 JOIN @nation n ON n.n_nationkey = c.c_nationkey
  JOIN @region r ON r.r_regionkey = n.n_regionkey
  JOIN @supplier s ON s.s_suppkey = c.c_custkey % 10
""",
    "hotel_history": r"""
SELECT event_id AS history_id, user_id AS hotel_id, ts AS event_date,
  CASE WHEN event_type = 'view' THEN 'name_change' WHEN event_type = 'click' THEN 'ownership_change' WHEN event_type = 'signup' THEN 'legal_status_change'
    WHEN event_type = 'purchase' THEN 'platform_change' ELSE 'address_change' END AS event_type,
  CASE WHEN event_id % 4 = 0 THEN 'hotel 5 stars booking.com' WHEN event_id % 4 = 1 THEN 'residential airbnb' WHEN event_id % 4 = 2 THEN 'commercial expedia closed' ELSE 'private rental open' END AS old_value,
  CASE WHEN event_id % 3 = 0 THEN 'residential airbnb' WHEN event_id % 3 = 1 THEN 'hotel 3 stars booking.com open' ELSE 'private rental closed' END AS new_value,
  CASE WHEN event_id % 5 = 0 THEN 'business_registry' ELSE 'auto_update' END AS source,
  CASE WHEN event_id % 17 = 0 THEN 'Permit renewal' ELSE '' END AS notes
FROM @events
""",
    "platforms": r"""
SELECT DISTINCT o_orderpriority AS id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'booking.com' WHEN o_orderpriority = '2-HIGH' THEN 'expedia' WHEN o_orderpriority = '3-MEDIUM' THEN 'airbnb'
    WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'vrbo' ELSE 'haraj' END AS platform_name,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'hotel' WHEN o_orderpriority IN ('3-MEDIUM','4-NOT SPECIFIED') THEN 'rental' ELSE 'local' END AS platform_type,
  o_orderpriority IN ('1-URGENT','2-HIGH') AS is_official
FROM @orders
""",
    "hotel_listings": r"""
SELECT o.o_orderkey AS listing_id, o.o_custkey AS hotel_id, o.o_orderpriority AS platform_id, o.o_orderdate AS first_seen_date, o.o_totalprice AS price,
  CASE WHEN o.o_orderstatus = 'F' THEN 'listing a' WHEN o.o_orderstatus = 'O' THEN 'listing b' ELSE NULL END AS name,
  CASE WHEN o.o_orderkey % 3 = 0 THEN 'Listing street' ELSE NULL END AS address, CASE WHEN o.o_orderkey % 7 = 0 THEN '+966-12-' || CAST(o.o_orderkey % 4 AS VARCHAR(4)) ELSE NULL END AS phone,
  CASE WHEN o.o_orderkey % 11 = 0 THEN 'Sales@Listing.example.com' ELSE '' END AS email, CASE WHEN o.o_orderkey % 13 = 0 THEN 'http://l.example.com' ELSE NULL END AS website, CAST(o.o_orderkey % 5 + 1 AS DOUBLE) AS stars
FROM @orders o
""",
    "place_reviews": r"""
SELECT doc_id AS review_id, doc_id % 50 AS place_id,
  CASE WHEN doc_id % 4 = 0 THEN 'The room was clean, towels and bed great. ' WHEN doc_id % 4 = 1 THEN 'Stayed one night, reception helped with the key. '
    WHEN doc_id % 4 = 2 THEN 'Ordered food from the menu. ' ELSE '' END || text AS review, lang
FROM @documents
""",
    "osm_elements": r"""
SELECT p_partkey AS osm_id, CASE WHEN p_size % 3 = 0 THEN 'way' ELSE 'node' END AS osm_type,
  CAST(24.0 AS DOUBLE) + (p_partkey % 101) * CAST(0.0006 AS DOUBLE) AS latitude, CAST(46.0 AS DOUBLE) + (p_partkey % 83) * CAST(0.0008 AS DOUBLE) AS longitude,
  CASE WHEN p_size % 7 = 0 THEN 'hotel' WHEN p_size % 7 = 1 THEN 'apartment' WHEN p_size % 7 = 2 THEN 'guest_house' WHEN p_size % 7 = 3 THEN 'attraction' ELSE NULL END AS tourism,
  CASE WHEN p_size % 7 = 4 THEN 'apartments' WHEN p_size % 7 = 5 THEN 'hotel' ELSE NULL END AS building,
  CASE WHEN p_size % 7 = 6 THEN 'mall' ELSE NULL END AS shop, CASE WHEN p_size % 5 = 0 THEN 'commercial' ELSE NULL END AS landuse, p_name AS name,
  CASE WHEN p_size % 11 = 0 THEN 'marketplace' WHEN p_size % 11 = 1 THEN 'museum' ELSE NULL END AS amenity, CASE WHEN p_size % 13 = 0 THEN 'castle' ELSE NULL END AS historic,
  CASE WHEN p_size % 17 = 0 THEN 'park' ELSE NULL END AS leisure, CASE WHEN p_size % 2 = 0 THEN 'en:' || p_name ELSE NULL END AS wikipedia, CASE WHEN p_size % 10 = 1 THEN 'Q' || CAST(p_partkey AS VARCHAR(12)) ELSE NULL END AS wikidata,
  CASE WHEN p_size % 4 = 1 THEN 'http://e.example.com' ELSE NULL END AS website, CASE WHEN p_size % 6 = 0 THEN p_type ELSE NULL END AS description,
  CASE WHEN p_size % 3 = 1 THEN CAST(p_size AS VARCHAR(4)) ELSE NULL END AS house_number, CASE WHEN p_size % 4 < 2 THEN p_brand || ' street' ELSE NULL END AS street, 'Riyadh' AS place, CASE WHEN p_size % 9 = 0 THEN CAST(11000 + p_size AS VARCHAR(8)) ELSE NULL END AS postcode
FROM @part
""",
    "stay_reviews": r"""
SELECT event_id AS review_id, user_id AS place_id,
  CASE WHEN user_id % 7 = 0 THEN CASE WHEN event_id % 3 = 0 THEN 'غرفة نظيفة و سرير مريح' WHEN event_id % 3 = 1 THEN 'استقبال جيد و مفتاح و مسبح قرب الفندق' ELSE 'طلبت الطعام من المنيو' END
    WHEN user_id % 7 < 4 THEN CASE WHEN event_id % 4 = 0 THEN 'Lovely room and bed, reception gave the key at night' WHEN event_id % 4 = 1 THEN 'We stay a week: towel, pillow, check-in and breakfast' WHEN event_id % 4 = 2 THEN 'Clean bathroom' ELSE '' END
    ELSE CASE WHEN event_id % 2 = 0 THEN 'Ordered food from the menu and went shopping for hours with all of the family' ELSE 'A meal of ' || event_type || ' near the hotel' END END AS review
FROM @events
""",
    "places": r"""
SELECT DISTINCT user_id AS place_id, user_id AS id, CASE WHEN user_id % 5 = 0 THEN 'Grand Hotel ' WHEN user_id % 5 = 1 THEN 'Building ' WHEN user_id % 5 = 2 THEN 'عمارة ' WHEN user_id % 5 = 3 THEN 'شقق مفروشة ' ELSE 'House ' END || CAST(user_id AS VARCHAR(12)) AS name,
  CASE WHEN user_id % 3 = 0 THEN 'restaurant' WHEN user_id % 3 = 1 THEN NULL ELSE 'building' END AS category
FROM @events
""",
    "scraped": r"""
SELECT o.o_orderkey AS id, CASE WHEN o.o_orderkey % 4 = 3 THEN NULL ELSE 'p' || CAST(o.o_custkey AS VARCHAR(12)) END AS place_id, CASE WHEN o.o_orderkey % 4 = 1 THEN NULL ELSE 'http://l.example.com/' || CAST(o.o_custkey AS VARCHAR(12)) END AS url,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE n.n_name || ' ' || r.r_name || ' house ' END AS name, CASE WHEN o.o_orderpriority = '3-MEDIUM' THEN 'airbnb' ELSE 'booking' END AS platform, o.o_totalprice AS price,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(24.0 AS DOUBLE) + (o.o_custkey % 97) * CAST(0.0007 AS DOUBLE) END AS latitude, CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE CAST(46.0 AS DOUBLE) + (o.o_custkey % 89) * CAST(0.0009 AS DOUBLE) END AS longitude
FROM @orders o JOIN @customer c ON c.c_custkey = o.o_custkey JOIN @nation n ON n.n_nationkey = c.c_nationkey JOIN @region r ON r.r_regionkey = n.n_regionkey
""",
    "archive_index": r"""
SELECT 'http://h' || CAST(o_custkey AS VARCHAR(12)) || '.example.com' AS url, replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), '-', '') || '12' || substr(CAST(100 + o_orderkey % 59 AS VARCHAR(4)), 2, 2) || substr(CAST(100 + o_orderkey % 53 AS VARCHAR(4)), 2, 2) AS timestamp, 'http://h' || CAST(o_custkey AS VARCHAR(12)) || '.example.com/' AS original,
  CASE WHEN o_orderkey % 10 = 0 THEN '404' ELSE '200' END AS statuscode, 'D' || CAST(o_orderkey % 3 AS VARCHAR(4)) AS digest
FROM @orders
""",
    "relationships": r"""
SELECT c_custkey AS hotel_id_a, CAST(c_custkey - c_custkey % 5 AS BIGINT) AS hotel_id_b FROM @customer WHERE c_custkey % 5 <> 0
""",
    "properties": r"""
SELECT c_custkey AS id, substr(md5('n' || CAST(c_custkey - c_custkey % 6 AS VARCHAR(12))), 1, 14) || CASE WHEN c_custkey % 3 = 0 THEN ' inn' WHEN c_custkey % 3 = 1 THEN ' in' ELSE ' Inn' END AS name,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE substr(md5('a' || CAST(c_custkey - c_custkey % 6 AS VARCHAR(12))), 1, 12) || ' street' END AS address,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(20.0 AS DOUBLE) + ((c_custkey - c_custkey % 6) % 1009) * CAST(0.01 AS DOUBLE) + (c_custkey % 6) * CAST(0.0001 AS DOUBLE) END AS latitude,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(46.0 AS DOUBLE) END AS longitude, CASE WHEN c_custkey % 5 = 0 THEN '+966-11-' || CAST(1000000 + c_custkey AS VARCHAR(12)) ELSE NULL END AS phone,
  'House of ' || substr(md5('o' || CAST((c_custkey - c_custkey % 6) % 300 AS VARCHAR(12))), 1, 16) AS owner, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS data_source
FROM @customer
""",
    "training_samples": r"""
SELECT d.doc_id, d.text AS name, d.text AS description, d.source AS category, CAST(d.n_chars % 50 AS DOUBLE) / 10 AS rating, l.quality AS is_hotel
FROM @documents d JOIN @labels l ON l.doc_id = d.doc_id
""",
    "hotel_history_long": r"""
SELECT o_orderkey AS history_id, o_custkey AS hotel_id, o_orderdate AS event_date,
  CASE WHEN o_orderkey % 6 = 0 THEN 'name_change' WHEN o_orderkey % 6 = 1 THEN 'ownership_change' WHEN o_orderkey % 6 = 2 THEN 'legal_status_change'
    WHEN o_orderkey % 6 = 3 THEN 'classification_change' WHEN o_orderkey % 6 = 4 THEN 'license_change' ELSE 'address_change' END AS event_type,
  CASE WHEN o_orderkey % 4 = 0 THEN 'hotel 5 stars' WHEN o_orderkey % 4 = 1 THEN 'residential' WHEN o_orderkey % 4 = 2 THEN 'commercial closed' ELSE 'private' END AS old_value,
  CASE WHEN o_orderkey % 7 < 3 THEN 'residential apartment' WHEN o_orderkey % 7 < 5 THEN 'hotel 3 stars open' ELSE 'private closed' END AS new_value,
  CASE WHEN o_orderstatus = 'F' THEN 'business_registry' ELSE 'auto_update' END AS source,
  CASE WHEN o_orderkey % 17 = 0 THEN 'Permit renewal' ELSE '' END AS notes
FROM @orders
""",
}


_TABLE = re.compile(r"@(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)\b")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name])
    return spark.sql(re.sub(r"TIMESTAMP '[^']+'", lambda m: f"CAST({m[0]} AS TIMESTAMP_NTZ)", sql))


def with_views(sql: str, *names: str) -> str:
    """DuckDB's query: the views as common table expressions before sql, which may go on with more after WITH."""
    parts = ", ".join(f"{n} AS ({_TABLE.sub(lambda m: m[1], VIEWS[n]).strip()})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts}, {body[15:]}"
    return f"WITH {parts}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {parts} {body}"
