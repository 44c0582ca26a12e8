"""Spelling variants by groups instead of pairs: wildcard groups for replacements, deletions that meet the vocabulary for insertions and deletions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, written

WORD, DELETION, WILDCARD = 0, 1, 2
_LETTERS = "a-zÀ-ÿ"


def variant_words(docs: DataFrame, least_chars: int = 7, one_in: int = 31) -> DataFrame:
    """(word): each occurrence of a word of least_chars code points at least in the texts; words are maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased.

    h being the crc32 of "doc_id:run", a run loses its code point h % length where one_in divides h. Null texts have no words, a null doc_id counts as empty text, repeated rows count each.
    Other columns are ignored.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), ascii_lower(F.col("text")).alias("text"))
    runs = base.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]{{{least_chars},}}"), 0)).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """(rank, word, n): the distinct words found least times or more. Ranks grow from the most frequent on, ties by code point, with gaps."""
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least), "words")
    return written(counts.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "vocabulary")


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of x and a seed."""
    x = x + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, kind, h1, h2) of each word itself, its distinct deletions, and the word with a wildcard at each position.

    A text's hash is the sum over its positions of a random number for position and code point, in 2 x 64 bits, so what a cut or a wildcard leaves follows from sums up to there:
    the work is linear in a word's length, however long.
    """
    size = np.array([len(w) for w in words], np.int64)
    if not size.sum():
        return (np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    of = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(code), dtype=np.int64) - np.repeat(end - size, size)
    place = at.astype(np.uint64) << np.uint64(21)
    repeats = np.zeros(len(code), bool)
    repeats[1:] = (code[1:] == code[:-1]) & (at[1:] > 0)  # deleting either of two equal neighbours leaves the same text
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        own, moved = _mixed(place | code, seed), _mixed((place - np.uint64(1 << 21)) | code, seed)
        sums, shifted = np.cumsum(own), np.cumsum(moved)
        start = np.where(end > size, sums[np.maximum(end - size - 1, 0)], np.uint64(0))
        total = sums[end - 1] - start
        deletion = sums - own - start[of] + shifted[end - 1][of] - shifted
        wildcard = total[of] - own + _mixed(place | np.uint64(0x1FFFFF), seed)
        out.append(np.concatenate([total, deletion[~repeats], wildcard]))
    kinds = np.repeat(np.array([WORD, DELETION, WILDCARD], np.int8), [len(words), (~repeats).sum(), len(code)])
    return np.concatenate([np.arange(len(words)), of[~repeats], of]), kinds, *out


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rank, words = b.column(0).to_numpy(), b.column(1).to_pylist()
        for i in range(0, len(words), 2000):
            of, kind, h1, h2 = variants(words[i : i + 2000])
            for j in range(0, len(of), 100_000):
                s = slice(j, j + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h1[s].view(np.int64)), pa.array(h2[s].view(np.int64)), pa.array(kind[s]), pa.array(rank[i + of[s]])], ["h1", "h2", "kind", "rank"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h1, h2, kind, rank): (rank, n_near, best) that a group gives a member.

    A wildcard group holds a word for each letter at one position, a deletion group one for each letter and place, so groups are small whatever the data; of a group only its size and its first
    two ranks count. The last group of a batch may go on: it is held back.
    """
    held = None

    def answers(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h1, h2, kind, rank = rows
        if not len(h1):
            return
        first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        size = np.diff(np.append(first, len(h1)))
        lead = np.repeat(first, size)
        wild = (kind == WILDCARD) & (np.repeat(size, size) > 1)
        least = np.arange(len(h1)) == lead
        second = rank[np.minimum(lead + 1, len(h1) - 1)]
        known = (kind[lead] == WORD) & (np.repeat(size, size) > 1)  # a word beside words that it is a deletion of
        use = wild | known
        near = np.where(wild | least, np.repeat(size, size) - 1, 1)
        best = np.where(least, second, rank[lead])
        yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (rank, near, best)], ["rank", "n_near", "best"])

    for b in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        open_ = np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]))[0]
        held = [x[open_:] for x in rows]
        yield from answers([x[:open_] for x in rows])
    if held is not None:
        yield from answers(held)


def neighbours(words: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words of a vocabulary() differ from each by one code point inserted, deleted or replaced, and the smallest rank of these; words without any are left out.

    Groups are known by 2 x 64 hash bits. Pairs are never formed: a replacement's group answers each member with its size and its first or second rank, and a deletion's group, if the
    vocabulary has its text, with what both sides need.
    """
    rows = words.select("rank", "word").mapInArrow(_expanded, "h1 long, h2 long, kind byte, rank long")
    dealt = rows.repartition("h1").sortWithinPartitions("h1", "h2", "kind", "rank")
    return dealt.mapInArrow(_met, "rank long, n_near long, best long").groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(rank, root): where the links (rank, to) end. Each round doubles the reach; a form is ten times as frequent as its word, so paths are short."""
    reach = written(links, "variant-links")
    while True:
        further = reach.select(F.col("rank").alias("to"), F.col("to").alias("further"))
        step = written(reach.join(further, "to", "left").select("rank", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "variant-links")
        discard(reach)
        reach = step.select("rank", "to")
        reach._written_at = step._written_at
        if step.where("moved").isEmpty():
            return reach.select("rank", F.col("to").alias("root"))


def grouped(words: DataFrame, times: int = 10) -> DataFrame:
    """The words of a vocabulary() with n_near, form (the near word of largest n, ties by code point, if that is `times` the word's n or more), form_n, and root, where forms lead; a word without a form is its own root."""
    named = lambda rank, word, n: words.select(F.col("rank").alias(rank), F.col("word").alias(word), F.col("n").alias(n))
    near = words.join(neighbours(words), "rank", "left").join(named("best", "form", "form_n"), "best", "left")
    has = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    all_ = written(near.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("best"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "variant-forms")
    ends = roots(all_.where("best IS NOT NULL").select("rank", F.col("best").alias("to"))).join(named("root", "root_word", "root_n"), "root").select("rank", "root_word")
    return all_.join(ends, "rank", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    """Words of 7 code points and 2 occurrences at least. An empty table, and texts without such words, give no row."""
    return grouped(vocabulary(variant_words(docs.select("doc_id", "text"))))
