"""Normalised lines of many texts at once, over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._hash import mix
from .repeats import Hashed

#: Characters of texts taken at a time; a longer text is cut at a line feed.
PIECE = 1 << 18
_MARKS = " .,;:!?\"'()[]{}<>*#$%&|-_/\\"
_WIDE_MARKS = "«»„“”’‘…¡¿–—"
_WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LANES = np.uint64(0x0101010101010101)
_CORE, _SPACE, _MARK, _FEED = 0, 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in _MARKS]] = _MARK
_KIND[[ord(c) for c in " \t\x0b\x0c\r\x1c\x1d\x1e\x1f"]] = _SPACE
_KIND[10] = _FEED


def unified(text: str) -> str:
    """Lower case, with one mark for all that ASCII has not, and one space."""
    text = text.lower()
    if not text.isascii():
        for c in _WIDE_MARKS:
            text = text.replace(c, '"')
        for c in _WIDE_SPACES:
            text = text.replace(c, " ")
    return text


def normal_line(line: str) -> str:
    """Words in lower case, without marks at their ends, with a space between."""
    return " ".join(filter(None, (w.strip(_MARKS) for w in unified(line).split())))


def pieces(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (text's number, first line's number, text or whole lines of it) of about PIECE characters."""
    out, size = [], 0
    for k, text in enumerate(texts):
        text, line = text or "", 0
        while len(text) > PIECE and (cut := text.find("\n", PIECE)) >= 0:
            yield [(k, line, text[:cut])]
            line += text.count("\n", 0, cut) + 1
            text = text[cut + 1 :]
        out.append((k, line, text))
        size += len(text)
        if size > PIECE:
            yield out
            out, size = [], 0
    if out:
        yield out


class Lines:
    """The lines with a word of some texts that lie end to end, with a line feed between.

    of: each line's place among all parts between line feeds; words: hashes of all words; starts: bounds of each line's words; chars: characters of each normalised line.
    """

    def __init__(self, texts: list[str]):
        data = np.frombuffer(unified("\n".join(texts)).encode("utf-8", "surrogatepass"), np.uint8)
        kind = _KIND[data]
        core = np.flatnonzero(kind == _CORE)
        run = np.cumsum(kind & 1, dtype=np.int32)[core]
        new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(core) else core
        self._first, self._end = core[new], core[np.r_[new[1:], len(core)] - 1] + 1 if len(core) else core
        line = np.cumsum(kind == _FEED, dtype=np.int32)[self._first]
        self.words = Hashed(data)(self._first, self._end) if len(core) else np.zeros(0, np.uint64)
        heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
        self.of = line[heads].astype(np.int64)
        self.starts = np.r_[heads, len(line)]
        count = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
        size = count[self._end - 1] - count[self._first] + 1
        self._sizes = size
        self.chars = np.add.reduceat(size, heads).astype(np.int64) + np.diff(self.starts) - 1 if len(heads) else np.zeros(0, np.int64)
        self._data = data

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each line's words, in order."""
        many = np.diff(self.starts)
        if not len(many):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        place = (np.arange(len(self.words)) - np.repeat(self.starts[:-1], many)).astype(np.uint64)
        return np.add.reduceat(mix(self.words ^ mix(place)), self.starts[:-1]), np.add.reduceat(mix(mix(self.words + place)), self.starts[:-1])

    def simhashes(self, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """SimHash of each line's words of more than so many characters, as often as they occur, and how many these are: a bit is that of most words; a tie gives 0."""
        on = self._sizes > longer
        many = np.add.reduceat(on.astype(np.int64), self.starts[:-1]) if len(self.of) else np.zeros(0, np.int64)
        out = np.zeros((len(many), 8), np.uint8)
        some = np.flatnonzero(many)
        if len(some):
            words, count = self.words[on], many[some]
            start = np.cumsum(count) - count
            # one bit of each byte at a time, added in the bytes' lanes, for which no run may pass 255 words
            parts = (count + 254) // 255
            part = np.repeat(start - 255 * (np.cumsum(parts) - parts), parts) + 255 * np.arange(parts.sum())
            first = np.cumsum(parts) - parts
            for j in range(8):
                lanes = np.add.reduceat((words >> np.uint64(j)) & _LANES, part)
                ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int32), first, axis=0)
                out[some] |= (ones * 2 > count[:, None]).astype(np.uint8) << np.uint8(j)
        return out.view(np.uint64).reshape(-1), many

    def letters(self, which: np.ndarray) -> np.ndarray:
        """For some of the lines how many characters of each of 16 kinds they have, 15 at most, in four bits each."""
        text = self.texts(which)
        offsets, data = (np.frombuffer(b, t) for b, t in zip(text.buffers()[1:], (np.int32, np.uint8), strict=True))
        data, line = data[: offsets[-1]], np.repeat(np.arange(len(text)), np.diff(offsets[: len(text) + 1]))
        on = (data & 0xC0) != 0x80
        many = np.minimum(np.bincount(line[on] * 16 + (data[on] & 15), minlength=16 * len(text)), 15).astype(np.uint64).reshape(-1, 16)
        return (many << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)

    def texts(self, which: np.ndarray) -> pa.Array:
        """The normalised lines of some of the lines."""
        many = np.diff(self.starts)[which]
        word = np.repeat(self.starts[:-1][which] - np.cumsum(many) + many, many) + np.arange(many.sum())
        head = np.zeros(len(word), bool)
        head[np.cumsum(many) - many] = True
        begin, end = self._first[word] - ~head, self._end[word]
        size = end - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        data = self._data[at]
        data[(np.cumsum(size) - size)[~head]] = 32
        offsets = np.r_[0, np.cumsum(np.add.reduceat(size, np.cumsum(many) - many))] if len(many) else np.zeros(1, np.int64)
        return pa.LargeStringArray.from_buffers(len(many), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
