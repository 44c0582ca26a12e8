"""License scans: an exact set-similarity join of text blocks with notice templates, in DataFrame functions only.

A block is a line of a text, or what stands around a line break inside a paragraph: as many words on each side as the longest template
has, so a notice that wraps over lines lies in one; as its set of words. It meets a template when the block holds at least `threshold` of the template's
distinct words. Tokens are ordered by their frequency over the whole corpus, rarest first. For that containment a block must hold one
of the template's first |T| - ceil(threshold |T|) + 1 tokens (prefix filter), have ceil(threshold |T|) of the templates' words (length
filter), and leave room behind the first shared token, in the template and in itself, for the rest of the overlap (positional filter);
what is left is verified.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, written

#: Characters of words once A-Z is lower-cased, and of words in the raw text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What parts paragraphs: lines without words.
BLANK_LINES = r"\n[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as they stand at the head of files, with the label each gives.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License"),
    ("agpl", "This program is licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "Released to the public domain under CC0 1.0 Universal"),
)


def template_words(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)))


def _vocabulary(templates) -> tuple[list[list[str]], list[str]]:
    sets = [template_words(t) for _, t in templates]
    return sets, sorted(set().union(*sets))


def _tokens(words: Column, vocabulary: list[str]) -> Column:
    return F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary]))


def _words(text: Column) -> Column:
    """Words of a text; at its ends there may be empty ones."""
    return F.split(ascii_lower(text), GAP)


def _around_breaks(paragraph: Column, reach: int) -> Column:
    """Of each line break of a paragraph, the words around it, `reach` on each side at most."""
    line = lambda x: let(F.array_remove(_words(x), ""), lambda w: F.when(F.size(w) > 2 * reach, F.concat(F.slice(w, 1, reach), F.slice(w, -reach, reach))).otherwise(w))
    last = lambda w: F.when(F.size(w) > reach, F.slice(w, -reach, reach)).otherwise(w)

    def windows(lines: Column) -> Column:
        # each line has a word, except at the paragraph's ends
        before = lambda k: let(F.flatten(F.slice(lines, F.greatest(k - reach, F.lit(1)), F.least(k, F.lit(reach + 1)))), last)
        after = lambda k: F.slice(F.flatten(F.slice(lines, k + 1, F.lit(reach + 1))), 1, reach)
        return F.transform(F.sequence(F.lit(1), F.size(lines) - 1), lambda k: F.concat(before(k), after(k)))

    return let(F.transform(F.split(paragraph, "\n"), line), windows)


def token_order(tokens: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Rank of each of the templates' words, rarest in the corpus first. tokens: (tokens), of every document. As many rows as the templates have words come to the driver."""
    n = {r["token"]: r["n"] for r in tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (n.get(w, 0), w)))}


def template_matches(docs: DataFrame, order: dict[str, int], text: str = "text", templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, text_hash, block, wrapped, template, label, containment) of each line, and each surrounding of a line break, that holds at least `threshold` of a template's words.

    block counts the lines; where wrapped, it counts the breaks inside paragraphs of several lines. Null and empty texts have no blocks; repeated rows give repeated matches. The template side is a constant table, so it may be broadcast.
    """
    sets, vocabulary = _vocabulary(templates)
    table, prefix_words = [], set()
    for i, (label, _) in enumerate(templates):
        words = sorted(sets[i], key=order.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        prefix = words[: len(words) - need + 1]
        prefix_words.update(prefix)
        table += [(i, label, words, need, k, w) for k, w in enumerate(prefix)]
    prefix = docs.sparkSession.createDataFrame(table, "template int, label string, words array<string>, need int, t_pos int, token string")
    some = f"(?i)(?:{'|'.join(re.escape(w) for w in sorted(prefix_words))})"  # lines without it have no token of a prefix
    ordered = F.array(*[F.lit(w) for w in sorted(vocabulary, key=order.__getitem__)])
    reach = max(len(re.findall(rf"{RAW_WORD}+", t)) for _, t in templates)
    hit = docs.where(F.col(text).rlike(some)).select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    lines = hit.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("block", "line")).where(F.col("line").rlike(some))
    lines = lines.select("doc_id", "text_hash", "block", F.lit(False).alias("wrapped"), _words(F.col("line")).alias("words"))
    paragraphs = hit.where(F.contains("text", F.lit("\n"))).select("doc_id", "text_hash", F.explode(F.split("text", BLANK_LINES)).alias("paragraph")).where(F.contains("paragraph", F.lit("\n")) & F.col("paragraph").rlike(some))
    breaks = paragraphs.select("doc_id", "text_hash", F.posexplode(_around_breaks(F.col("paragraph"), reach)).alias("block", "words")).withColumn("wrapped", F.lit(True))
    blocks = lines.unionByName(breaks).select("doc_id", "text_hash", "block", "wrapped", F.array_intersect(ordered, "words").alias("tokens"))  # in the global order
    probes = blocks.select("doc_id", "text_hash", "block", "wrapped", "tokens", F.posexplode("tokens").alias("b_pos", "token"))
    hits = probes.join(F.broadcast(prefix), "token").where(F.size("tokens") >= F.col("need"))  # length filter
    hits = hits.withColumn("shared", F.filter("words", lambda w: F.array_contains("tokens", w)))
    first = F.get("shared", F.lit(0)) == F.col("token")  # each block and template once: at their first shared token
    room = F.least(F.size("words") - F.col("t_pos"), F.size("tokens") - F.col("b_pos")) >= F.col("need")  # positional filter
    met = hits.where(room & first & (F.size("shared") >= F.col("need")))
    return met.select("doc_id", "text_hash", "block", "wrapped", "template", "label", (F.size("shared") / F.size("words")).alias("containment"))


def may_match(tokens: Column, templates=TEMPLATES, threshold: float = 0.9) -> Column:
    """The length filter for whole texts: whether a text's words, of which its blocks' are a part, include `threshold` of some template's."""
    sets, _ = _vocabulary(templates)
    enough = [F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))) >= math.ceil(threshold * len(words) - 1e-9) for words in sets]
    return reduce(lambda x, y: x | y, enough, F.lit(False))


def _phrase_pattern() -> str:
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return rf"(?i)(?<!{RAW_WORD})(?-i)(?:{'|'.join(gap.join(''.join(f'[{c}{c.upper()}]' for c in w) for w in p.split()) for p in PHRASES)})(?!{RAW_WORD})".replace("(?i)", "").replace("(?-i)", "")


def base(docs: DataFrame, text: str = "text", vocabulary: list[str] = ()) -> DataFrame:
    """docs with tokens (its words that vocabulary has), n_words, n_base, first_word, last_word and base_set: places where a phrase's words stand consecutively. Null text: no words, no places."""
    pattern = _phrase_pattern()
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda x: F.size(F.array_remove(_words(x), "")).cast("long")
    zero = F.lit(None).cast("struct<n:bigint,first:bigint,last:bigint,labels:array<string>>")

    def places(p: Column) -> Column:
        found = ascii_lower(F.element_at(p["f"], -1))
        n_last = F.when(found.startswith("general"), 3).otherwise(2)
        labels = F.transform(p["f"], lambda x: F.when(ascii_lower(x).startswith("mit"), "mit").when(ascii_lower(x).startswith("apache"), "apache").otherwise("gpl"))
        return F.when(F.size(p["f"]) > 0, F.struct(F.size(p["f"]).cast("long").alias("n"), count(F.get(p["s"], F.lit(0))).alias("first"), (count(t) - count(F.element_at(p["s"], -1)) - n_last).alias("last"), F.array_distinct(labels).alias("labels")))

    hit = F.when(t.rlike("(?i)license") & t.rlike(pattern), let(F.struct(F.regexp_extract_all(t, F.lit(pattern), 0).alias("f"), F.split(t, pattern, -1).alias("s")), places)).otherwise(zero)
    own = ("n_words", "n_base", "first_word", "last_word", "base_set", "tokens")
    words = let(_words(t), lambda w: F.struct(F.size(F.array_remove(w, "")).cast("long").alias("n"), _tokens(w, list(vocabulary) or [""]).alias("tokens")))
    out = docs.select([c for c in docs.columns if c not in (*own, "_hit", "_w")]).withColumns({"_w": words, "_hit": hit})
    out = out.withColumns({"n_words": F.col("_w.n"), "tokens": F.col("_w.tokens")}).drop("_w")
    return out.withColumns({"n_base": F.coalesce("_hit.n", F.lit(0)).cast("long"), "first_word": F.col("_hit.first"), "last_word": F.col("_hit.last"), "base_set": F.coalesce("_hit.labels", F.array().cast("array<string>"))}).drop("_hit")


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """Per row of docs: doc_id, the base columns, labels and score; score is 1 where a phrase stands, else the largest containment met, else 0.

    docs is read once: texts whose words, wherever they stand, are enough for a template go on with the base columns to the join of blocks.
    Rows that repeat doc_id and text share their result. Other columns are left out.
    """
    vocabulary = _vocabulary(templates)[1]
    own = base(docs.select("doc_id", text).withColumn("text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit("")))), text, vocabulary)
    own = written(own.withColumn(text, F.when(may_match(F.col("tokens"), templates, threshold), F.col(text))), "license-base")
    order = token_order(own, vocabulary)
    met = template_matches(own, order, text, templates, threshold).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("set"), F.max("containment").alias("best"))
    met = met.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "set", "best")
    j = own.drop(text).join(met, (F.col("text_hash") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    comma = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return j.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        comma(F.col("base_set")).alias("base_labels"),
        comma(F.concat("base_set", F.coalesce("set", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)


def oracle_sql(threshold: float = 0.9) -> str:
    rows = ", ".join(f"({i}, '{label}', {template_words(t)!r})" for i, (label, t) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}+') AS w FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE t LIKE '%license%'),
p AS (SELECT doc_id, CASE WHEN w[i + 1] = 'license' AND w[i] IN ('mit', 'apache') THEN w[i] WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END AS label, i - 1 AS i FROM i),
b AS (SELECT doc_id, count(*)::BIGINT AS n, min(i)::BIGINT AS a, max(i)::BIGINT AS z, list(DISTINCT label) AS l FROM p WHERE label IS NOT NULL GROUP BY 1),
tpl(template, label, words) AS (VALUES {rows}),
x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
y AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{WORD}+')) AS s FROM x WHERE regexp_matches(line, 'licen|cc0|redistrib|permission')
  OR len(list_intersect(regexp_extract_all(line, '{WORD}+'), (SELECT flatten(list(words)) FROM tpl))) >= (SELECT min(ceil({threshold} * len(words) - 1e-9)) FROM tpl)),
m AS (SELECT doc_id, list(DISTINCT label) AS l, max(len(list_intersect(words, s)) / len(words)) AS best FROM y, tpl WHERE len(list_intersect(words, s)) >= ceil({threshold} * len(words) - 1e-9) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base, b.a AS first_word, b.z AS last_word,
  array_to_string(list_sort(coalesce(b.l, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.l, []), coalesce(m.l, [])))), ',') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.best, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


ORACLE_SQL = oracle_sql()
