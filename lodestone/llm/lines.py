"""Operator 8: fuzzy line dedup.

Lines are normalised (words in lower case, without marks at their ends) and equal ones become one class. Pigeonholes bring classes together that may be
similar enough. Of lines of up to SHORT characters all pairs are met: a line of n has floor(n / 10) + 1 segments, one of which an edit distance of
floor(n / 10) leaves whole, near its place. Longer ones meet by the KEYS windows of a few words whose hashes are the least; changed places leave the
windows between them whole. Pairs that meet are linked if the SimHashes of lines of many words are within BITS, and the edit similarity is high enough. Of each
connected group the first occurrence is kept.

Blocks of a SimHash of 64 bits can't be the pigeonholes: a tenth of the words changed turns about nine bits (arccos(0.9) / pi of 64), for which blocks would be of six
bits and meet one pair of all lines in 64; within the three bits that blocks afford are 54 of the 424 pairs of tests/llm/test_line_recall.py, the windows meet all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _edits, _graph, _lines, _util
from ._hash import mix
from ._lines import normal_line  # noqa: F401  the norm of a line, for tests

#: Least edit similarity (1 - distance / length of the longer).
SIMILARITY = 0.9
#: Characters up to which all pairs of lines are met; windows by which a longer line is met; most words of a window; characters of the windows of lines of few words.
SHORT, KEYS, WINDOW, GRAM = 39, 8, 5, 8
#: Characters up to which the kinds of letters of a line of few words are counted.
LETTERS = 120
#: Bits in which the SimHashes of linked lines may differ (of unlike lines they differ in 26 or so), the least words that make one, and characters that a word of it has more of.
BITS, HASHED, LONGER = 22, 12, 3
#: Words from which on all windows have WINDOW words and any two changed words leave one of them whole; words up to which windows of characters are taken too.
LONG, FEW = 3 * WINDOW + 2, 6
_MUL = [mix(np.uint64([k]))[0] | np.uint64(1) for k in range(1, 1 + max(WINDOW, GRAM))]


def most_edits(n: int) -> int:
    """Edits that a line of n characters, the longer of two, may have."""
    return int(n * (1 - SIMILARITY) + 1e-9)


def segment_keys(line: str) -> set[int]:
    """Buckets of a short line: its segments, and what of it may equal a segment of a line as long or longer.

    With the edits of the first segments summed up, the first i at which they are no more than i is a segment without any, with i edits
    before it and the rest, at most edits - i, behind it; both bound how far it has moved.
    """
    m, out = len(line), set()
    for n in range(m, SHORT + 1):
        edits = most_edits(n)
        if n - m > edits:
            break
        if not edits:
            continue
        at = [n * i // (edits + 1) for i in range(edits + 2)]
        for i in range(edits + 1):
            long = at[i + 1] - at[i]
            for start in range(at[i] + max(-i, m - n - edits + i), at[i] + min(i, m - n + edits - i) + 1):
                if 0 <= start <= m - long:
                    out.add(xxhash.xxh3_64_intdigest(f"{n} {i} {line[start : start + long]}".encode("utf-8", "surrogatepass")))
    return out


def window_sizes(words: int) -> set[int]:
    """Words of a line's windows: a third of its words, WINDOW at most, and what lines of a word more or less have."""
    return {max(1, min(WINDOW, n // 3)) for n in (words - 1, words, words + 1)}


_SIZES = np.array([[size in window_sizes(n) for n in range(LONG + 1)] for size in range(1, WINDOW + 1)])


def least_keys(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The KEYS least distinct keys of each line (of), in order of line and key."""
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])] if len(key) else np.zeros(0, bool)
    key, of = key[new], of[new]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
    return key[rank < KEYS], of[rank < KEYS]


def window_keys(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and their lines, from word hashes of lines that lie end to end (starts: their bounds; none empty)."""
    many = np.diff(starts)
    line = np.repeat(np.arange(len(many)), many)
    left = starts[line + 1] - np.arange(len(words))
    short = np.minimum(many, LONG)
    # of many windows, those that can hardly be among the least are not sorted
    bound = np.where(many > 4 * KEYS, np.float64(2**64) * 3 * KEYS / np.maximum(many, 1), np.float64(2**64)).clip(0, 2**64 - 2048).astype(np.uint64)
    keys, of = [], []
    h = np.zeros(len(words), np.uint64)
    for size in range(1, WINDOW + 1):
        h[: len(words) - size + 1] += words[size - 1 :] * _MUL[size - 1]
        at = np.flatnonzero((left >= size) & _SIZES[size - 1, short[line]])
        key = mix(h[at] ^ np.uint64(size))
        on = key <= bound[line[at]]
        if size == WINDOW:
            few = (np.bincount(line[at[on]], minlength=len(many)) < KEYS) & (many > 4 * KEYS)
            on |= few[line[at]]
        keys.append(key[on])
        of.append(line[at[on]])
    return least_keys(np.concatenate(keys), np.concatenate(of))


def gram_keys(line: str) -> np.ndarray:
    """Keys of a line of few words: the least of its windows of GRAM characters."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < GRAM:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(c) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h += mix(c[k : len(c) - GRAM + 1 + k]) * _MUL[k]
    return np.unique(mix(~h))[:KEYS]


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, h, line_no, c1, c2 (hash of the normalised line), buckets, n_words, n_chars, bits (SimHash, null for lines of few words), letters (of short ones of few words) of each line with a word of docs(doc_id, text, h)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _lines.pieces(b.column(1).to_pylist()):
                found = _lines.Lines([text for _, _, text in part])
                many, chars = np.diff(found.starts), found.chars
                of, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                # a longer one of more than SHORT characters may have a shorter one of fewer
                windowed = chars >= SHORT + 1 - most_edits(SHORT + 1)
                by_text = np.flatnonzero((chars <= SHORT) | windowed & (many <= FEW))
                for k, line in zip(by_text.tolist(), found.texts(by_text).to_pylist(), strict=True):
                    mine = segment_keys(line) if len(line) <= SHORT else set()
                    if windowed[k]:
                        mine |= set(gram_keys(line).tolist())
                    of.append(np.full(len(mine), k))
                    keys.append(np.fromiter(mine, np.uint64, len(mine)))
                on = np.flatnonzero(windowed)
                if len(on):
                    at = np.repeat(found.starts[on] - np.cumsum(many[on]) + many[on], many[on]) + np.arange(many[on].sum())
                    key, line = window_keys(found.words[at], np.concatenate([[0], np.cumsum(many[on])]))
                    of.append(on[line])
                    keys.append(key)
                of, keys = np.concatenate(of), np.concatenate(keys)
                keys = keys[np.argsort(of, kind="stable")].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(many)))]).astype(np.int32)
                c1, c2 = found.hashes()
                bits, hashed = found.simhashes(LONGER)
                few = (hashed < HASHED) & (chars <= LETTERS)
                letters = np.zeros(len(many), np.uint64)
                letters[few] = found.letters(np.flatnonzero(few)) if few.any() else 0
                doc, number = _places(part, found.of)
                doc = pa.array(doc)
                yield pa.record_batch(
                    [b.column(0).take(doc), b.column(2).take(doc), pa.array(number.astype(np.int32)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.array(many.astype(np.int32)), pa.array(chars.astype(np.int32)), pa.array(bits.view(np.int64), mask=hashed < HASHED), pa.array(letters.view(np.int64), mask=~few)],
                    ["doc_id", "h", "line_no", "c1", "c2", "buckets", "n_words", "n_chars", "bits", "letters"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, h long, line_no int, c1 long, c2 long, buckets array<long>, n_words int, n_chars int, bits long, letters long")


def _places(part: list[tuple[int, int, str]], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the number within it of lines, given their places among all lines of the part."""
    many = np.array([text.count("\n") + 1 for _, _, text in part])
    first = np.cumsum(many) - many
    which = np.searchsorted(first, of, side="right") - 1
    return np.array([k for k, _, _ in part])[which], of - first[which] + np.array([line for _, line, _ in part])[which]


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, line: the normalised lines of wanted(id, doc_id, h, line_no)."""
    by_doc = wanted.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("line_no", "id"))).alias("wanted"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(2), pa.array([z.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)], pa.binary())], ["doc_id", "h", "text"])

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            wanted = b.column(1)
            sizes = wanted.value_lengths().to_numpy()
            flat = wanted.flatten()
            doc, number, ids = np.repeat(np.arange(len(b)), sizes), flat.field(0).to_numpy(), flat.field(1)
            for part in _lines.pieces([z.decompress(t.as_py()).decode("utf-8", "surrogatepass") for t in b.column(0)]):
                found = _lines.Lines([text for _, _, text in part])
                of, no = _places(part, found.of)
                key = of << 32 | no
                on = np.flatnonzero((doc >= part[0][0]) & (doc <= part[-1][0]) & np.isin(doc << 32 | number, key))
                yield pa.record_batch([ids.take(pa.array(on)), found.texts(np.searchsorted(key, doc[on] << 32 | number[on]))], ["id", "line"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where("doc_id IS NOT NULL").mapInArrow(packed, f"doc_id {kind}, h long, text binary")
    return texts.join(by_doc, ["doc_id", "h"]).select("text", "wanted").mapInArrow(normal, "id long, line string")


#: Characters of lines whose edits are counted at a time.
EDITED = 1 << 20


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b of those of (a, b, s, t) whose lines have the edit similarity."""

    def done(some: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        b = pa.Table.from_batches(some).combine_chunks()
        alike = _edits.within(b.column(2).to_pylist(), b.column(3).to_pylist(), 1 - SIMILARITY)
        return b.filter(pa.array(alike)).select(["a", "b"]).combine_chunks().to_batches()

    some, size = [], 0
    for b in batches:
        some.append(b)
        size += b.nbytes
        if size > EDITED:
            yield from done(some)
            some, size = [], 0
    if some:
        yield from done(some)


def _may_meet(rows: pa.Table, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What _may_be_alike() leaves of the pairs of rows x and rows y (of n, bits, letters); of each x those of the nearest length first."""
    n, bits, letters = (rows.column(c) for c in ("n", "bits", "letters"))
    n = n.to_numpy()
    y = y[np.argsort(n[y], kind="stable")]
    share = SIMILARITY - 1e-9
    low, high = np.searchsorted(n[y], np.floor(n[x] * share) - 1), np.searchsorted(n[y], np.ceil(n[x] / share) + 1, side="right")
    many = high - low
    i = np.repeat(x, many)
    j = y[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    most = np.floor(np.maximum(n[i], n[j]) * (1 - SIMILARITY) + 1e-9)
    apart = np.abs(n[i] - n[j])
    hashed, words = bits.is_valid().to_numpy(), bits.fill_null(0).to_numpy()
    on = (apart <= most) & (~(hashed[i] & hashed[j]) | (np.bitwise_count(words[i].view(np.uint64) ^ words[j].view(np.uint64)) <= BITS))
    i, j, most, apart = i[on], j[on], most[on], apart[on]
    few, kinds = letters.is_valid().to_numpy(), letters.fill_null(0).to_numpy().view(np.uint64)
    both = np.flatnonzero(few[i] & few[j])
    a, b, sum_ = kinds[i[both]], kinds[j[both]], np.zeros(len(both), np.int64)
    for k in range(16):
        sum_ += np.abs((a >> np.uint64(4 * k) & np.uint64(15)).astype(np.int64) - (b >> np.uint64(4 * k) & np.uint64(15)).astype(np.int64))
    on = np.ones(len(i), bool)
    on[both] = sum_ <= 2 * most[both]
    i, j, apart = i[on], j[on], apart[on]
    order = np.lexsort((apart, i))
    return i[order], j[order]


def _rows_alike(rows: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the lines of pairs of rows have the edit similarity."""
    line, n = rows.column("line"), rows.column("n").to_numpy()
    size = np.cumsum(n[x] + n[y]) // EDITED
    bounds = np.r_[np.flatnonzero(np.r_[True, size[1:] != size[:-1]]), len(x)] if len(x) else np.zeros(1, np.int64)
    out = [np.zeros(0, bool)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        s, t = (line.take(pa.array(r[a:b])).to_pylist() for r in (x, y))
        out.append(_edits.within(s, t, 1 - SIMILARITY))
    return np.concatenate(out)


def _may_be_alike(y: str) -> str:
    """SQL: false for pairs of lines that their lengths, SimHashes or letters keep apart. An edit takes one letter away at most, and adds one at most."""
    most = f"floor(greatest(n, {y}n) * {1 - SIMILARITY:.6f}D + 1e-9D)"
    apart = " + ".join(f"abs((shiftright(letters, {4 * k}) & 15) - (shiftright({y}letters, {4 * k}) & 15))" for k in range(16))
    return f"abs(n - {y}n) <= {most} AND coalesce(bit_count(bits ^ {y}bits), 0) <= {BITS} AND coalesce({apart}, 0) <= 2 * {most}"


def _grouped(docs: DataFrame) -> DataFrame:
    """What fuzzy_lines() returns, with h, the hash of the row's text."""
    _util.small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    scanned = _util.materialize(_scanned(docs).withColumn("rid", F.monotonically_increasing_id()))
    # by halves, so that the shuffle files of one half only lie beside both tables
    halves, entries = [], 0
    for k, half in enumerate(("c1 < 0", "c1 >= 0")):
        classes = scanned.where(f"doc_id IS NOT NULL AND {half}").groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "line_no", "rid", "h")).alias("first"), F.first("buckets").alias("buckets"), F.first("n_chars").alias("n"), F.first("bits").alias("bits"), F.first("letters").alias("letters"))
        classes, seen = _util.materialize_seen(classes.withColumn("id", F.monotonically_increasing_id() * 2 + k), F.sum(F.size("buckets")).alias("entries"))
        halves.append(classes)
        entries += seen["entries"] or 0
    # what the lists of buckets are for is in classes
    wide, scanned = scanned, _util.materialize(scanned.select("doc_id", "h", "line_no", "c1", "c2", "n_words", "rid"))
    _util.discard(wide)
    shared = _util.materialize(_graph.shared_buckets(halves[0].unionByName(halves[1]), entries))
    # lists and places of the classes that meet another one, and of all classes what names them
    kept, classes_of = [], []
    for half in halves:
        kept.append(_util.materialize(half.join(shared.select("id").distinct(), "id", "left_semi").select("id", "first.doc_id", "first.h", "first.line_no", "buckets", "n", "bits", "letters")))
        classes_of.append(_util.materialize(half.select("id", "c1", "c2", F.struct("first.doc_id", "first.line_no", "first.rid").alias("first"))))
        _util.discard(half)
    wanted, classes = (a.unionByName(b) for a, b in (kept, classes_of))
    met = _util.materialize(shared.join(wanted.select("id", "n", "bits", "letters"), "id"))
    _util.discard(shared)
    # rows that repeat a doc_id and its text have the same lines
    texts = _util.materialize(_texts(_util.one_each(docs), wanted.select("id", "doc_id", "h", "line_no")))

    def verify(pairs: DataFrame) -> DataFrame:
        s, t = texts.toDF("a", "s"), texts.toDF("b", "t")
        return pairs.join(s, "a").join(t, "b").select("a", "b", "s", "t").mapInArrow(_alike, "a long, b long")

    def blocks(rest: DataFrame) -> DataFrame:
        return _graph.in_blocks(rest, wanted.select("id", "buckets").join(texts, "id"), "a long, b long", lambda it: _graph.looked_for(it, _may_meet, _rows_alike))

    of = _graph.linked(met, wanted.select("id", "buckets"), _may_be_alike, f"floor(ln(n) / {-math.log(SIMILARITY - 1e-4)!r}D)", verify, blocks)
    groups = classes.select("id", "c1", "c2", "first").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = groups.groupBy("component").agg(F.min("first").alias("first"))
    named = _util.materialize(groups.select("c1", "c2", "component").join(first, "component").select("c1", "c2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"), F.col("first.rid").alias("_rid")))
    for old in (*kept, *classes_of, met, texts, of):
        _util.discard(old)
    out = scanned.join(named, ["c1", "c2"], "left")
    return out.selectExpr("doc_id", "h", "line_no", "n_words", *[f"CASE WHEN doc_id IS NOT NULL THEN {c} END AS {c}" for c in ("first_doc_id", "first_line_no")], "doc_id IS NULL OR rid = _rid AS kept")


def fuzzy_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, n_words, first_doc_id, first_line_no, kept: the lines with a word, by group.

    line_no counts from 0 the parts of a text between line feeds. Of each group one line is kept, the first by doc_id and
    line_no, of one row only where rows repeat a doc_id. Rows without doc_id are compared with nothing and keep their lines. Lines without a
    word are not listed; a null text has no lines. Lines that meet are linked when the edit similarity of the
    normalised lines is at least SIMILARITY and, of lines of many words, the SimHashes differ in no more than BITS. Equal lines are one class, never paired.
    """
    return _grouped(docs).drop("h")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that fuzzy_lines() does not keep; a text that loses lines is joined anew by line feeds.

    Texts of which nothing but white space is left lose their row; texts that lost nothing stay as they are. Rows that repeat a doc_id and its text are one
    row; rows of one doc_id with different texts each lose their own lines only.
    """
    docs = _util.one_each(docs)
    gone = _grouped(docs).where("NOT kept").groupBy("doc_id", "h").agg(F.collect_list("line_no").alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("h"))
    left = F.expr("element_at(transform(array(split(row.text, '\n', -1)), _l -> array_join(transform(array_except(sequence(0, size(_l) - 1), gone), i -> get(_l, i)), '\n')), 1)")
    joined = rows.join(gone, ["doc_id", "h"], "left").withColumn("row", F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField("text", left)))
    return joined.where("gone IS NULL OR row.text RLIKE '[^ \\t-\\r]'").select("row.*")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fuzzy groups of all lines of documents."""
    return fuzzy_lines(_util.table(spark, sf_dir, "documents"))
