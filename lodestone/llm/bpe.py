"""Byte-level BPE by a priority queue of merge ranks over a doubly linked symbol list.

Only the vocabulary file is read; segmentation, merging and decoding are done here. The results equal those of the
`tokenizers` library for files whose pre-tokenizer is ByteLevel with its usual pattern (tests/llm/test_bpe.py).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import regex

_SPACE = r"\p{White_Space}"
#: The byte-level segmentation, with white space spelt as the Unicode property so that control characters are not taken for it.
SEGMENTS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+")
#: White space. Only where some stands beside a blank does a segment reach over the blank.
_BLANKS = [c for c in map(chr, range(0x3001)) if regex.match(_SPACE, c)]
_ASCII_BLANKS = [c for c in _BLANKS if c < "\x80"]
_POS = 32
_MASK = (1 << _POS) - 1
_ID = 20
#: A worker keeps the last so many chunks it has encoded, twice that at most. Longer chunks are not kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class ByteBPE:
    """Encoder and decoder for one vocabulary file (tokenizers' JSON, byte-level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.first = [vocab[alphabet[b]] for b in range(256)]
        #: Of a pair of ids the rank plus 1, shifted to leave room for a place.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = [0]
        for rank, pair in enumerate(spec["model"]["merges"], 1):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << _ID | vocab[b]] = rank << _POS
            self.merged.append(vocab[a + b])
        self._of_bytes = [[self.ranks.get(a << _ID | b, 0) for b in self.first] for a in self.first]
        #: Bytes that each id stands for.
        self.pieces: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.names = [str(i) for i in range(self.size)]
        self._kept: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one segment. An entry of the queue is the rank and place of a pair in one integer; it is stale unless it is still the pair's own."""
        first, of_bytes = self.first, self._of_bytes
        ids = [first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        own = [r and r | i for i, r in enumerate([of_bytes[a][b] for a, b in zip(data, data[1:], strict=False)])]
        own.append(0)
        queue = [e for e in own if e]
        if not queue:
            return ids
        heapify(queue)
        rank_of, merged = self.ranks.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & _MASK
            if own[i] != entry:
                continue
            j = after[i]
            new = ids[i] = merged[entry >> _POS]
            ids[j], own[i], own[j] = -1, 0, 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank_of(new << _ID | ids[k])
                if r:
                    own[i] = r | i
                    heappush(queue, r | i)
            h = before[i]
            if h >= 0:
                r = rank_of(ids[h] << _ID | new)
                if r:
                    own[h] = r | h
                    heappush(queue, r | h)
                else:
                    own[h] = 0
        return [x for x in ids if x >= 0]

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings; these stand at the odd places."""
        return self._special.split(text) if self._special and any(s in text for s in self.special) else [text]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Cut before blanks that no segment reaches over, so that each distinct chunk needs segmentation once. Joined, they are the text."""
        if not text:
            return []
        if any(c in text and (c + " " in text or " " + c in text) for c in (_ASCII_BLANKS if text.isascii() else _BLANKS) if c != " ") or "  " in text:
            return SEGMENTS.findall(text)
        first, *rest = text.split(" ")
        chunks = [" " + x for x in rest]
        return [first, *chunks] if first else chunks

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        found = self._older.get(chunk)
        if found is None:
            segments = SEGMENTS.findall(chunk)
            found = tuple(self.merge(chunk.encode("utf-8", "surrogatepass"))) if len(segments) == 1 else tuple(chain.from_iterable(self._kept.get(s) or self._chunk(s) for s in segments))
        if len(chunk) <= CACHE_CHARS:
            if len(self._kept) >= CACHE_ENTRIES:
                self._older, self._kept = self._kept, {}
            self._kept[chunk] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                ids.append(self.special[part])
            else:
                chunks = self.chunks(part)
                found = list(map(self._kept.get, chunks))
                if None in found:
                    found = [self._chunk(c) if x is None else x for c, x in zip(chunks, found, strict=True)]
                ids.extend(chain.from_iterable(found))
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary strings one after the other; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")

    def count(self, segment: str) -> int:
        """Ids of one pre-token or special string."""
        return 1 if segment in self.special else len(self.merge(segment.encode("utf-8", "surrogatepass")))

    def segments(self, text: str) -> Iterator[str]:
        """Pre-tokens and special strings in order."""
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                yield part
            else:
                yield from SEGMENTS.findall(part)


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """The vocabulary, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")).hexdigest()
