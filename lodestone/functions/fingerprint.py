"""Stable fingerprints of findings: FNV-1a over the identifying cells, of which the low 48 bits are kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SCHEME = "1"
_PRIME, _OFFSET = np.uint64((1 << 40) + 0x1B3), 0xCBF29CE484222325


def _hashed(texts: pa.Array) -> pa.Array:
    """FNV-1a of the texts' bytes, as hex digits: of all texts that are long enough one byte at a time."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, many = offsets[:-1][order], np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")
    state = np.full(n, _OFFSET, np.uint64)
    for k, m in enumerate(many.tolist()):
        state[:m] = (state[:m] ^ data[start[:m] + k]) * _PRIME
    out = np.empty(n, np.uint64)
    out[order] = state
    digits = out.astype(">u8").tobytes().hex()
    # nulls are shared, digits are 16 a text
    found = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int64)), pa.py_buffer(digits.encode()))
    return pc.if_else(texts.is_valid(), found.cast(pa.string()), pa.scalar(None, pa.string()))


_fnv1a = F.arrow_udf(_hashed, StringType())


def fnv1a(text: Column) -> Column:
    """FNV-1a of 64 bits over the UTF-8 bytes, as 16 hex digits; null of null."""
    return _fnv1a(text)


def normalize_site(line: Column) -> Column:
    """A site's text without spans and line numbers, with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, "@.*$", ""), r":\d+$", ""), r"\s+", " "))


def fingerprint(check: Column, cells: list[Column], site: Column) -> Column:
    """Twelve hex digits from the scheme, the check, the text cells in order and the site's own line. Numbers, and so line numbers, take no part."""
    return F.substring(fnv1a(F.concat_ws("\u0001", F.lit(SCHEME), check, *cells, normalize_site(site))), 5, 12)
