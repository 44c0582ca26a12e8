"""Byte-pair token counts and ids: whole batches of pre-tokens merged as ragged numpy arrays, rank by rank in step.

The words of a batch lie end to end in one array of symbol ids. In each round every word that still has a mergeable pair finds its
lowest rank and merges all its pairs of that rank at once, left to right; words without one are done. What survives is the tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from itertools import chain

import numpy as np
import regex

#: Texts of these characters alone lower-case and compose alike in Python and in the tokenizers library; others take the library's normaliser.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧‰-⁞€™]*")
_SPACE = r"\p{White_Space}"
_CACHE = 400_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


class PairTable:
    """Pairs of symbols that merge: left and right symbol, the pair's rank and the symbol it makes. Symbols are below size; what has no pair may be any number."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, size: int):
        order = np.argsort(left * size + right, kind="stable")
        self.keys, self.rank, self.size, self.none = (left * size + right)[order], rank[order], size, int(rank.max(initial=0)) + 1
        self.made = np.zeros(self.none, np.int64)
        self.made[rank] = made
        lowest = np.full(size, self.none)
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        #: Ranks whose product takes part in a merge of a lower rank: these merge one pair at a time, as that merge may come first.
        self.alone = lowest[self.made] < np.arange(self.none)

    def ranks(self, a: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each of the given symbols, of which none is the last of a; `none` where there is none."""
        k = a[at] * self.size + a[at + 1]
        key = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[key] == k) & (word[at] == word[at + 1]), self.rank[key], self.none)

    def merge(self, a: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that survive, word by word, and how many each word has. a: the symbols of all words end to end; word: the number of each symbol's word."""
        done_ids, done_words = [], []
        none = self.none
        rank = np.full(len(a), none)
        if len(a) > 1:
            rank[:-1] = self.ranks(a, word, np.arange(len(a) - 1))
        a = a.copy()
        while len(a):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            n = np.diff(np.r_[first, len(a)])
            low = np.repeat(low, n)
            over = low == none
            if over.any():  # words without a pair left are out
                done_ids.append(a[over])
                done_words.append(word[over])
                a, word, rank, low = a[~over], word[~over], rank[~over], low[~over]
                if not len(a):
                    break
            hit = np.flatnonzero(rank == low)
            # in runs of hits that overlap (x x x), each other one merges, from the left; of ranks that go alone, the word's first
            fresh = np.r_[True, np.diff(hit) > 1] if len(hit) else np.zeros(0, bool)
            run = np.flatnonzero(fresh)
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))
            take = place % 2 == 0
            lone = self.alone[rank[hit]]
            if lone.any():
                take &= ~lone | np.r_[True, word[hit][1:] != word[hit][:-1]]
            hit = hit[take]
            a[hit] = self.made[rank[hit]]
            keep = np.ones(len(a), bool)
            keep[hit + 1] = False
            a, word, rank = a[keep], word[keep], rank[keep]
            # only pairs with a symbol just made have another rank
            new = hit - np.arange(len(hit))
            at = np.concatenate([new[new > 0] - 1, new])
            last = at == len(a) - 1
            rank[at[last]] = none
            rank[at[~last]] = self.ranks(a, word, at[~last])
        ids, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_ids, done_words))
        order = np.argsort(at, kind="stable")
        return ids[order], np.bincount(at, minlength=n_words)


class WordBpe:
    """The tokenizer of a tokenizers .json file with BPE over words, by rank-synchronous merging.

    Special strings in a text are their one token, as by the library's default. Words already met are looked up; the table holds
    `_CACHE` words and then starts anew, so memory is bounded and results are the same.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalizer = Tokenizer.from_file(path).normalizer
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.specials) + ")") if self.specials else None
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+").findall
        plain = {kind: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
        gap = "".join(re.escape(c) for c in map(chr, range(0x2030)) if regex.match(_SPACE, c))
        self.find_plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{plain['L']}]+|[{plain['N']}]|[^{gap}{plain['L']}{plain['N']}]+").findall
        letters = byte_symbols()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab["".join(m)] for m in merges], np.int64)
        self.pairs = PairTable(left, right, np.arange(len(merges)), made, self.size)
        self.cache: dict[str, np.ndarray | int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """Of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return self.find_plain((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        return self.find(self.normalizer.normalize_str(text))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words end to end, and how many each word has."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        a = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        a[ends] = self.final[np.frombuffer(b"".join(raw), np.uint8)[ends]]
        return self.pairs.merge(a, word, len(words))

    def _pieces(self, text: str) -> list[tuple[list[str], int | None]]:
        """Pre-tokens of each stretch between special strings, with the id of the special string after it."""
        if self.cut is None or "<|" not in text:
            return [(self.pre_tokens(text), None)]
        parts = self.cut.split(text)
        return [(self.pre_tokens(p), self.specials[parts[i + 1]] if i + 1 < len(parts) else None) for i, p in enumerate(parts) if i % 2 == 0]

    def _learn(self, words: Iterable[str], kept) -> None:
        """All words get into the table, in blocks of bounded size; kept(ids, n): what the table holds of each word of a block."""
        words = set(words)
        if len(self.cache) + len(words) > _CACHE:
            self.cache.clear()
        fresh = list(words.difference(self.cache))
        while fresh:
            size = 0
            for n, w in enumerate(fresh, 1):
                size += len(w)
                if size > 400_000:
                    break
            block, fresh = fresh[:n], fresh[n:]
            self.cache.update(zip(block, kept(*self.merge(block))))

    def _blocks(self, texts: Iterable[str | None], kept):
        """The pieces of each text; those of some MB of text are looked up together, so their unknown words are merged in one batch."""
        held, size = [], 0

        def known():
            self._learn(chain.from_iterable(words for pieces in held for words, _ in pieces), kept)
            yield from held
            held.clear()

        for t in texts:
            held.append(self._pieces(t or ""))
            size += len(t or "")
            if size > 2_000_000:
                yield from known()
                size = 0
        yield from known()

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """Tokens of each text; a null one has none. An instance serves either counts() or ids()."""
        get = self.cache.__getitem__
        return np.array([sum(sum(map(get, words)) + (special is not None) for words, special in pieces) for pieces in self._blocks(texts, lambda ids, n: n.tolist())], np.int64)

    def ids(self, texts: Iterable[str | None]):
        """The token ids of each text, as arrays of unsigned 32-bit numbers."""
        get = self.cache.__getitem__

        def kept(ids, n):
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            return [raw[i:j] for i, j in zip([0, *ends], ends)]

        for pieces in self._blocks(texts, kept):
            parts = [b"".join(map(get, words)) + (b"" if special is None else special.to_bytes(4, "little")) for words, special in pieces]
            yield np.frombuffer(parts[0] if len(parts) == 1 else b"".join(parts), "<u4")
