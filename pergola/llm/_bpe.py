"""Byte-pair merging over the tables of a public tokenizer file."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex

# The letters, numbers and white space of the first 256 code points, for a quicker pattern on texts that have no others.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
TAILS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge table of one vocabulary. last_mark: what the last symbol of a word carries, or ''."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.last_mark = model.get("end_of_word_suffix") or ""
        self.symbols = byte_symbols()
        self.first = [vocab[s] for s in self.symbols]
        self.final = [vocab[s + self.last_mark] for s in self.symbols]
        self.rank: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.pieces: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        byte_of = {s: bytes([b]) for b, s in enumerate(self.symbols)}
        for s, i in vocab.items():
            self.pieces[i] = b"".join(byte_of[c] for c in (s[: -len(self.last_mark)] if self.last_mark and s.endswith(self.last_mark) else s))
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        marks = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.specials = re.compile(f"({marks})") if marks else None

    def _start(self, word: bytes) -> list[int]:
        ids = [self.first[b] for b in word]
        if ids:
            ids[-1] = self.final[word[-1]]
        return ids

    def _merged(self, word: bytes) -> tuple[list[int], list[int], int]:
        """Symbols, links to the next living symbol, and the number of merges made.

        A heap holds adjacent pairs by (rank, place); a pair is stale once one of its sides has been merged away or changed.
        """
        ids = self._start(word)
        n, rank, merges = len(ids), self.rank, 0
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = rank.get(ids[i] << 32 | ids[i + 1])
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                found = rank.get(made << 32 | ids[k])
                if found:
                    heapq.heappush(heap, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = rank.get(ids[h] << 32 | made)
                if found:
                    heapq.heappush(heap, (found[0], h, ids[h], made, found[1]))
        return ids, after, merges

    def count(self, word: bytes) -> int:
        """Tokens of a word: its symbols less the merges made; no identifiers leave."""
        if len(word) < 2:
            return len(word)
        return len(word) - self._merged(word)[2]

    def encode(self, word: bytes) -> list[int]:
        ids, after, _ = self._merged(word)
        out, i = [], 0
        while i < len(ids):
            out.append(ids[i])
            i = after[i]
        return out

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings: even places are text, odd ones the strings themselves."""
        return self.specials.split(text) if self.specials else [text]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    """One table a process, however many tasks it runs."""
    return Merges(path)


def narrow(text: str) -> bool:
    """Whether every character is among the first 256 code points."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Byte-level vocabularies keep a leading space with its word and every other white space.
SPACED = regex.compile(rf"{TAILS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")
SPACED_NARROW = re.compile(f"{TAILS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
#: Vocabularies with word ends drop white space and take digits one by one.
ENDED = regex.compile(rf"{TAILS}|\p{{L}}+|\p{{N}}|[^\s\p{{L}}\p{{N}}]+")
ENDED_NARROW = re.compile(f"{TAILS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


def spaced_words(text: str) -> list[str]:
    return (SPACED_NARROW if narrow(text) else SPACED).findall(text)


def ended_words(text: str) -> list[str]:
    return (ENDED_NARROW if narrow(text) else ENDED).findall(text)
