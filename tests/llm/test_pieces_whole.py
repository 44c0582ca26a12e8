import collections
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from innsight.llm import piece_scan

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_query_decodes_and_digests_all_chunks(spark):
    sp, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(9)
    giant = "".join(rnd.choice(["tion ", "abc", "é", " the", "漢"]) for _ in range(30000))
    rows = [(1, "short text"), (1, "short text"), (2, giant), (2, giant), (3, None), (None, "b c"), (4, "x"), (4, "y")]
    got = sorted(map(tuple, piece_scan.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = []
    for i, t in {(i, t or "") for i, t in rows}:
        ids = sp.encode(t)
        chunks = max(1, -(-(len(t) + 1) // 32768)) if len(t) > 32768 else 1
        want.append((i, len(ids), chunks, zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(t.encode()), len(t)))
    assert got == sorted(want, key=str)


def test_repeated_rows_are_one_document_at_every_length(spark):
    rows = [(1, "ab cd"), (1, "ab cd"), (2, "é" * 400), (2, "é" * 400)]
    encoded = piece_scan.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PIECES, chunk=200)
    n = collections.Counter(r["doc_id"] for r in encoded.collect())
    assert n == {1: 1, 2: 3}
    assert {(r["doc_id"], r["text"]) for r in piece_scan.decode(encoded, PIECES).collect()} == set(rows)


def test_crcs_of_parts_combine():
    rnd = random.Random(2)
    parts = [bytes(rnd.randrange(256) for _ in range(n)) for n in (0, 1, 5, 0, 300, 70000)]
    assert piece_scan.crc_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_chunks_of_any_length_equal_the_library():
    sp, own, rnd = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_scan.loaded(PIECES), random.Random(4)
    for _ in range(60):
        t = "".join(rnd.choice(["tion", "ab", " ", "  ", " the", "é", "漢", "1,", "\n"]) for _ in range(rnd.randrange(1, 200)))
        s = piece_scan.escaped(t)
        length = rnd.choice([33, 47, 100])
        cuts = [*range(0, len(s), length), len(s)]
        chunks = [own.matrix(s, a, b) for a, b in zip(cuts, cuts[1:])]
        at = piece_scan.states(chunks, len(s))
        got = [i for k, (a, b) in enumerate(zip(cuts, cuts[1:])) for i in own.trace(s, a, b, at[k], at[k + 1]).tolist()]
        assert got == sp.encode(t), (t, length)
