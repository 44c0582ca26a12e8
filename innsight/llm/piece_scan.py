"""SentencePiece BPE encoding and decoding as a max-plus scan over chunks.

A sequence of pieces is the model's encoding exactly when each two neighbours, joined and encoded alone, come apart as they are. So a
text's encoding is the one path of weight 0 through the pieces that match it (all others weigh -inf). A giant text is cut into chunks of
fixed length. The state at a cut is the piece over it, as its start and end; a chunk's transfer matrix has the best weight from each
state at its left end to each at its right. Matrices combine associatively by the max-plus product; then each chunk, given the states at
its ends, is traced back on its own, wherever it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairTable

SPACE = "▁"
_WORDS = re.compile("▁+[^▁]*").findall
_WORD = re.compile("▁+[^▁]*").match
NONE = -np.inf
State = tuple[int, int]  # a piece's start and end; (0, 0) is the text's beginning
_OUT = "doc_id long, row long, chunk int, ids array<int>"
_IDS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()), ("ids", pa.list_(pa.int32()))])
_SUMS = "doc_id long, row long, chunk int, n_pieces long, ids_crc32 long, n_chars long, n_bytes long, text_crc32 long"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32())] + [(c, pa.int64()) for c in ("n_pieces", "ids_crc32", "n_chars", "n_bytes", "text_crc32")])


class Pieces:
    """The vocabulary of a .model file of type BPE with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(sp.vocab_size())]
        self.score = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.vocab_size()) if not skip[i]}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.text = {i: p for p, (_, i) in self.score.items()}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.raw = [bytes([self.of_byte[i]]) if i in self.of_byte else self.text.get(i, "").encode() for i in range(sp.vocab_size())]
        self.longest = max(map(len, self.score))
        ranked = sorted((p for p in self.score if len(p) > 1 and not p.startswith(SPACE * 2)), key=lambda p: -self.score[p][0])
        ranks = {p: k for k, p in enumerate(ranked)}
        pairs = [(self.score[p[:k]][1], self.score[p[k:]][1], ranks[p], self.score[p][1]) for p in ranked for k in range(1, len(p)) if p[:k] in self.score and p[k:] in self.score]
        self.size = sp.vocab_size()
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*pairs)), self.size)
        self.alone: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.split: dict[str, list[str]] = {}

    def bpe(self, s: str) -> list[str]:
        """Pieces of a short string: the pair of the best score merges first, the leftmost of equals."""
        a = list(s)
        while True:
            best = min(((-self.score[x + y][0], i) for i, (x, y) in enumerate(zip(a, a[1:])) if x + y in self.score), default=None)
            if best is None:
                return a
            a[best[1] : best[1] + 2] = [a[best[1]] + a[best[1] + 1]]

    def fits(self, x: str, y: str) -> bool:
        """Whether y may follow x."""
        key = (x, y)
        if key not in self.alone:
            if len(self.alone) > 500_000:
                self.alone.clear()
            self.alone[key] = self.bpe(x + y) == [x, y]
        return self.alone[key]

    def at(self, text: str, i: int) -> list[int]:
        """Ends of the pieces that match at i; a character that is no piece stands alone."""
        out = [e for e in range(i + 2, min(i + self.longest, len(text)) + 1) if text[i:e] in self.score]
        return [i + 1, *out]

    def ids(self, piece: str) -> list[int]:
        own = self.score.get(piece)
        return [own[1]] if own else [self.bytes[b] for b in piece.encode("utf-8", "replace")]

    def walk(self, text: str, lo: int, hi: int, starts: list[State], keep: bool = False):
        """Of each piece over hi, the set of starts it is reached from, as bits; with keep, what came before each piece too. Between words (before a SPACE that follows another character) any pieces fit.

        keep makes the paths' middle, too; without it all words between the first and the last that begins before hi are passed over, as each is one path of weight 0.
        """
        reach: dict[State, int] = {s: 1 << k for k, s in enumerate(starts)}
        ending: dict[int, list[State]] = {}
        for s in starts:
            ending.setdefault(s[1], []).append(s)
        before: dict[State, State] = {}
        p, stop = min(ending) - 1, 0
        while (p := max(p + 1, stop)) < hi:
            if p >= lo and p in ending and 0 < p < len(text) and text[p] == SPACE != text[p - 1]:  # between words: what follows doesn't depend on what came
                if not keep and (q := self.boundary_before(text, hi)) > p:
                    own = 0
                    for s in ending.pop(p):
                        own |= reach[s]
                    s = (q - 1, q)  # any piece that ends there does
                    reach[s] = reach.get(s, 0) | own
                    ending = {q: [s]} | {e: live for e, live in ending.items() if e > q}
                    p = q - 1
                    continue
                stop = _WORD(text, p).end()
                if stop <= hi:
                    live, last, own = ending.pop(p), None, 0
                    for s in live:
                        own |= reach[s]
                        last = s if reach[s] else last
                    at = p
                    for piece in self.parts(text[p:stop]):
                        s = (at, at + len(piece))
                        reach[s] = own
                        if keep:
                            before[s] = last
                        last, at = s, at + len(piece)
                    ending.setdefault(stop, []).append(last)
                    continue
                stop = 0
            for last in ending.pop(p, ()) if p >= lo else ():
                x, own = text[last[0] : last[1]], reach[last]
                for e in self.at(text, p):
                    if not x or self.fits(x, text[p:e]):
                        s = (p, e)
                        if s not in reach:
                            reach[s] = 0
                            ending.setdefault(e, []).append(s)
                        reach[s] |= own
                        if keep:
                            before[s] = last
        over = {s: reach[s] for e, own in ending.items() if e >= hi for s in own}
        return (over, before) if keep else over

    @staticmethod
    def boundary_before(text: str, hi: int) -> int:
        """Where the last word that begins before hi does; 0 where none does."""
        q = text.rfind(SPACE, 0, hi)
        while q > 0 and text[q - 1] == SPACE:
            q -= 1
        return max(q, 0)

    @staticmethod
    def boundary_from(text: str, lo: int) -> int:
        """Where the first word that begins at lo or later does, the length of the text where none does."""
        while (q := text.find(SPACE, lo)) > 0 and text[q - 1] == SPACE:
            lo = q + 1
        return q if q > 0 else len(text)

    def parts(self, word: str) -> list[str]:
        """Pieces of a word, looked up where it was met before; a long one's by the walk."""
        if word not in self.split:
            if len(self.split) > 200_000:
                self.split.clear()
            if len(word) <= 64:
                self.split[word] = self.bpe(word)
            else:
                over, before = self.walk(word, 0, len(word), [(0, 0)], keep=True)
                s, out = next(s for s, own in over.items() if own and s[1] == len(word)), []
                while s != (0, 0):
                    out.append(word[s[0] : s[1]])
                    s = before[s]
                return out[::-1]
        return self.split[word]

    def entries(self, text: str, cut: int) -> list[State]:
        """All pieces that may lie over a cut (cover the character before it)."""
        if cut == 0:
            return [(0, 0)]
        return [(i, e) for i in range(max(0, cut - self.longest), cut) for e in self.at(text, i) if e >= cut]

    def matrix(self, text: str, lo: int, hi: int) -> tuple[list[State], list[State], np.ndarray]:
        """The transfer matrix of the chunk [lo, hi) and the states of its rows and columns."""
        rows, cols = self.entries(text, lo), self.entries(text, hi)
        over = self.walk(text, lo, hi, rows)
        m = np.full((len(rows), len(cols)), NONE)
        for j, s in enumerate(cols):
            for i in range(len(rows)):
                if over.get(s, 0) >> i & 1:
                    m[i, j] = 0.0
        return rows, cols, m

    def trace(self, text: str, lo: int, hi: int, left: State, right: State) -> np.ndarray:
        """Ids of the pieces after left up to right. Whole words between them are looked up; the path is walked in the words over the ends alone."""
        p, q = self.boundary_from(text, max(left[1], 1)), self.boundary_before(text, right[0] + 1)
        if p >= q:
            return np.array(self._walked(text, lo, hi, left, right), "<u4")
        head = []
        if left[1] < p:
            over, before = self.walk(text, min(lo, left[1]), p, [left], keep=True)
            head = self._back(text, before, left, next(s for s, own in over.items() if own and s[1] == p))
        tail = self._walked(text, q, hi, (q - 1, q), right)
        return np.concatenate([np.array(head, "<u4"), self.looked_up([words(text[p:q])])[0], np.array(tail, "<u4")])

    def _walked(self, text: str, lo: int, hi: int, left: State, right: State) -> list[int]:
        return self._back(text, self.walk(text, lo, hi, [left], keep=True)[1], left, right)

    def _back(self, text: str, before: dict[State, State], left: State, right: State) -> list[int]:
        out, s = [], right
        while s != left:
            out.append(text[s[0] : s[1]])
            s = before[s]
        return [i for piece in reversed(out) for i in self.ids(piece)]

    def learn(self, fresh: list[str]) -> None:
        """Puts words into the table: short ones by merging all in step as ragged arrays; long ones, and those with runs of SPACE, whose pieces' scores tie, by the scan."""
        if len(self.words) + len(fresh) > 400_000:
            self.words.clear()
        plain = [w for w in fresh if len(w) <= 64 and not w.startswith(SPACE * 2)]
        self.words.update((w, np.array(scan(self, w, 256), "<u4").tobytes()) for w in fresh if len(w) > 64 or w.startswith(SPACE * 2))
        for i in range(0, len(plain), 40_000):
            block = plain[i : i + 40_000]
            text = "".join(block)
            other = {c: self.size + k for k, c in enumerate(dict.fromkeys(c for c in set(text) if c not in self.score))}
            of = {c: self.score[c][1] for c in set(text) if c in self.score} | other
            a = np.fromiter(map(of.__getitem__, text), np.int64, len(text))
            ids, n = self.pairs.merge(a, np.repeat(np.arange(len(block)), np.fromiter(map(len, block), np.int64, len(block))), len(block))
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            own = [raw[x:y] for x, y in zip([0, *ends], ends)]
            if other:
                back = {k: np.array(self.ids(c), "<u4").tobytes() for c, k in other.items()}
                own = [b"".join(back.get(int(k), k.tobytes()) for k in np.frombuffer(x, "<u4")) if max(np.frombuffer(x, "<u4")) >= self.size else x for x in own]
            self.words.update(zip(block, own))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. No piece has SPACE behind another character, so words are independent chunks whose end states are known; those not met before are encoded together."""
        return self.looked_up([words(escaped(t)) for t in texts])

    def looked_up(self, parts: list[list[str]]) -> list[np.ndarray]:
        need = set().union(*parts)
        fresh = [w for w in need if w not in self.words]
        if len(self.words) + len(fresh) > 400_000:
            fresh = list(need)
        if fresh:
            self.learn(fresh)
        return [np.frombuffer(b"".join(map(self.words.__getitem__, p)), "<u4") for p in parts]

    def decoded(self, ids) -> bytes:
        """The UTF-8 bytes of ids, each SPACE a blank, the one before the text among them."""
        return b"".join(map(self.raw.__getitem__, ids)).replace(SPACE.encode(), b" ")

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        return self.decoded(ids).decode("utf-8", "replace").removeprefix(" ")


def escaped(text: str | None) -> str:
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def words(s: str) -> list[str]:
    """Parts of an escaped text that begin with a run of SPACE."""
    return _WORDS(s)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product, which is associative."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def states(chunks: list[tuple[list[State], list[State], np.ndarray]], end: int) -> list[State]:
    """The state of the one path of weight 0 at each cut, first and last included: by products from the left and from the right."""
    left = [np.zeros((1, 1))]
    for _, _, m in chunks:
        left.append(product(left[-1], m))
    right = np.where([s[1] == end for s in chunks[-1][1]], 0.0, NONE)[:, None]
    out = []
    for (rows, cols, m), own in zip(reversed(chunks), reversed(left)):
        out.append(cols[int(np.argmax(own.ravel() + right.ravel()))])
        right = product(m, right)
    return [(0, 0), *reversed(out)]


def scan(pieces: Pieces, s: str, length: int) -> list[int]:
    """Ids of an escaped text by chunks of a length."""
    cuts = [*range(0, len(s), length), len(s)]
    chunks = [pieces.matrix(s, a, b) for a, b in zip(cuts, cuts[1:])]
    at = states(chunks, len(s))
    return [i for k, (a, b) in enumerate(zip(cuts, cuts[1:])) for i in pieces._walked(s, a, b, at[k], at[k + 1])]


@lru_cache(maxsize=4)
def loaded(path: str) -> Pieces:
    return Pieces(path)


def _out(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def encode(docs: DataFrame, path: str, text: str = "text", chunk: int = 32768) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), chunk and ids: the ids of each document in chunks, in order of chunk.

    Texts of up to `chunk` characters are one chunk. Longer ones are dealt out in chunks: their matrices are made in parallel, combined
    per document, and each chunk is traced back in a task of its own. Rows that repeat doc_id and text are one document, at every length. Null and empty texts have one chunk without ids. Other columns are left out.
    """
    return _chunks(docs, path, text, chunk, lambda own, ids, chunk: (ids,), _OUT, _IDS)


def _digest(own: Pieces, ids: np.ndarray, chunk: int) -> tuple[int, int, int, int, int]:
    """Of a chunk: number and CRC of its ids, and characters, bytes and CRC of the text decoded from them. A character's bytes are one piece's ids, so they lie in one chunk."""
    text = own.decoded(ids.tolist())
    if chunk == 0:
        text = text.removeprefix(b" ")
    plain = text.decode("utf-8", "replace")
    text = plain.encode()
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(plain), len(text), zlib.crc32(text)


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of bytes end to end, from the (crc, number of bytes) of each part: a part's CRC moves on by the zero bytes of what follows it."""
    total = 0
    for crc, n in parts:
        total = _moved(total, n) ^ crc
    return total


@lru_cache(maxsize=1)
def _doublings() -> list[list[int]]:
    """Per k, what 2^k zero bytes make of each bit of a CRC's register."""
    step = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit
    out = []
    for k in range(64):
        for _ in range(3 if k == 0 else 1):
            step = [_times(step, step[i]) for i in range(32)]
        out.append(step)
    return out


def _times(matrix: list[int], v: int) -> int:
    total, i = 0, 0
    while v:
        if v & 1:
            total ^= matrix[i]
        v, i = v >> 1, i + 1
    return total


def _moved(crc: int, n: int) -> int:
    k = 0
    while n and crc:
        if n & 1:
            crc = _times(_doublings()[k], crc)
        n, k = n >> 1, k + 1
    return crc


def _chunks(docs: DataFrame, path: str, text: str, chunk: int, made, out: str, schema: pa.Schema) -> DataFrame:
    """doc_id, row, chunk and what made(pieces, ids, chunk) makes of each chunk's ids in the task that finds them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text"))
    long_ = F.length(F.coalesce("text", F.lit(""))) > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                d, r, t = (c.to_pylist() for c in b.slice(a, 500).columns)
                yield _out([(*x, 0, *made(own, ids, 0)) for *x, ids in zip(d, r, own.encode(t))], schema)

    # a chunk travels with its surroundings, in which the pieces over its ends lie; positions count from the window's beginning
    pad = 32
    s = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    giant = rows.where(long_).distinct().select("doc_id", "row", s.alias("s"))
    window = giant.select("doc_id", "row", F.length("s").alias("n"), "s", F.explode(F.sequence(F.lit(0), ((F.length("s") - 1) / chunk).cast("int"))).alias("chunk"))
    begin = F.greatest(F.col("chunk") * chunk - pad, F.lit(0))
    window = window.select("doc_id", "row", "n", "chunk", begin.alias("begin"), F.substr("s", begin + 1, F.lit(chunk + 2 * pad)).alias("s"))
    # chunks are costly for their size: a fixed number of partitions, as Spark would merge small ones
    window = window.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "chunk")

    def bounds(c: int, begin: int, n: int) -> tuple[int, int]:
        return c * chunk - begin, min((c + 1) * chunk, n) - begin

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, schema = loaded(path), pa.schema([("row", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32()), ("rows", pa.list_(pa.int32())), ("cols", pa.list_(pa.int32())), ("m", pa.binary())])
        for b in batches:
            for _, r, n, c, begin, t in zip(*(x.to_pylist() for x in b.columns)):
                rows_, cols, m = own.matrix(t, *bounds(c, begin, n))
                flat = lambda at: [x + begin for p in at for x in p]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((r, c, n, flat(rows_), flat(cols), m.tobytes()), schema)], schema=schema)

    def combined(table: pa.Table) -> pa.Table:
        at = sorted(table.to_pylist(), key=lambda x: x["chunk"])
        pairs = lambda v: list(zip(v[::2], v[1::2]))
        chunks = [(pairs(x["rows"]), pairs(x["cols"]), np.frombuffer(x["m"]).reshape(len(x["rows"]) // 2, -1)) for x in at]
        found = states(chunks, at[0]["n"])
        return pa.table({"row": pa.array([x["row"] for x in at], pa.int64()), "chunk": pa.array([x["chunk"] for x in at], pa.int32()), "ends": pa.array([[*p, *q] for p, q in zip(found, found[1:])], pa.list_(pa.int32()))})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        for b in batches:
            for d, r, n, c, begin, t, ends in zip(*(x.to_pylist() for x in b.columns)):
                e = [x - begin if k > 1 or c else x for k, x in enumerate(ends)]
                yield _out([(d, r, c, *made(own, own.trace(t, *bounds(c, begin, n), (e[0], e[1]), (e[2], e[3])), c))], schema)

    m = window.mapInArrow(matrices, "row long, chunk int, n int, rows array<int>, cols array<int>, m binary")
    ends = m.groupBy("row").applyInArrow(combined, "row long, chunk int, ends array<int>")
    parts = window.join(ends, ["row", "chunk"]).select("doc_id", "row", "n", "chunk", "begin", "s", "ends").mapInArrow(traced, out)
    return rows.where(~long_).mapInArrow(whole, out).unionByName(parts).dropDuplicates(["doc_id", "row", "chunk"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, row and the text of encode()'s chunks. Chunks are joined per document, as its bytes may lie on both sides of a cut."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        for b in batches:
            out = [own.decode([i for c in sorted(x.as_py(), key=lambda y: y["chunk"]) for i in c["ids"]]) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["doc_id", "row", "text"])

    per = encoded.groupBy("doc_id", "row").agg(F.collect_list(F.struct("chunk", "ids")).alias("chunks"))
    return per.mapInArrow(texts, "doc_id long, row long, text string")


def digests(docs: DataFrame, path: str, text: str = "text", chunk: int = 32768) -> DataFrame:
    """Per document, a distinct pair of doc_id and text: doc_id, n_pieces, n_chunks, ids_crc32 of all ids of encode() in order, and text_crc32 and n_chars of the text that decode() makes of them.

    Each chunk is encoded and decoded again in one task, which gives a digest; ids don't travel, and the CRCs of a document's chunks combine to those of the whole.
    """
    per = _chunks(docs, path, text, chunk, _digest, _SUMS, _DIGESTS)
    fields = ["chunk", "n_pieces", "ids_crc32", "n_chars", "n_bytes", "text_crc32"]
    per = per.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"), *[F.sum(c).alias(c) for c in ("n_pieces", "n_chars")])

    @F.arrow_udf("struct<ids_crc32 long, text_crc32 long>")
    def joined(chunks: pa.Array) -> pa.Array:
        rows = [([(c["ids_crc32"], 4 * c["n_pieces"]) for c in x], [(c["text_crc32"], c["n_bytes"]) for c in x]) for x in chunks.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([crc_joined(r[k]) for r in rows], pa.int64()) for k in (0, 1)], ["ids_crc32", "text_crc32"])

    return per.select("doc_id", "n_pieces", F.size("chunks").cast("long").alias("n_chunks"), "n_chars", joined("chunks").alias("x")).select("doc_id", "n_pieces", "n_chunks", "x.ids_crc32", "x.text_crc32", "n_chars")


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
