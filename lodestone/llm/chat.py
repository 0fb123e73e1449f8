"""Operator 2: chat formatting with offset-aligned masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its turns are intersected with the
spans of its tokens by binary search: a token is under the loss mask if it lies in the text of an assistant's turn. The
template's marks are added to the tokenizer as special tokens, so no token reaches over the border of a text.

Template of a turn: `<s>` role `[INST]` text `[/INST]` `</s>`. Inside roles and texts a backslash is doubled, and one is put after
the first character of each control string; unescape() takes both back.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _util
from .bpe import digest

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
MARKS = (BEGIN, OPEN, CLOSE, END)
#: The marks, and the tokenizer's own special string.
CONTROL = (*MARKS, "<|endoftext|>")
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)
DEFAULT = "byte_bpe_50k.json"
#: Conversations encoded at a time: encodings with offsets take a hundred times the room of their texts.
ENCODED = 16
_LOADED: dict[str, object] = {}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The formatted conversation, the spans of its texts, and those of the texts of assistants."""
    out, at, spans, loss = [], 0, [], []
    for role, text in turns:
        head, body = BEGIN + escape(role) + OPEN, escape(text)
        at += len(head)
        spans.append((at, at + len(body)))
        if role == "assistant":
            loss.append(spans[-1])
        out += [head, body, CLOSE + END]
        at += len(body) + len(CLOSE + END)
    return "".join(out), spans, loss


def mask(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """For each token span (sorted) whether it overlaps one of the spans (sorted, disjoint): two binary searches for each span."""
    starts, ends = [a for a, _ in tokens], [b for _, b in tokens]
    out = [False] * len(tokens)
    for a, b in spans:
        if a < b:
            lo, hi = bisect_right(ends, a), bisect_left(starts, b)
            out[lo:hi] = [True] * max(0, hi - lo)
    return out


def tokenizer(path: str):
    """The tokenizer with the template's marks as special tokens after its own ids."""
    if path not in _LOADED:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.no_padding()
        t.no_truncation()
        t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
        _LOADED[path] = t
    return _LOADED[path]


def gather(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns array<struct<role, text>>: rows by turn; ties and repeated rows by role and text, each kept; null turns first.

    A null role or text is an empty one. Rows without conv_id form one conversation. A conversation is one row of the result
    and so is held by one task, as its encoding needs it whole.
    """
    rows = df.select(F.col(f"`{conv_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def format_chat(df: DataFrame, path: str, **columns: str) -> DataFrame:
    """conv_id, formatted string, ids array<int>, offsets array<int> (start and end of each token, in code points of formatted), loss array<boolean>.

    One row for each conversation; rows as in gather().
    """
    _util.small_batches(df.sparkSession)
    rows = gather(df, **columns)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = tokenizer(path)
        for b in _util.slices(batches, ENCODED):
            made = [render([(x["role"], x["text"]) for x in turns]) for turns in b.column(1).to_pylist()]
            coded = t.encode_batch([m[0] for m in made], add_special_tokens=False)
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([e.ids for e in coded], pa.list_(pa.int32())),
                    pa.array([[x for o in e.offsets for x in o] for e in coded], pa.list_(pa.int32())),
                    pa.array([mask(e.offsets, m[2]) for e, m in zip(coded, made, strict=True)], pa.list_(pa.bool_())),
                ],
                ["conv_id", "formatted", "ids", "offsets", "loss"],
            )

    return rows.mapInArrow(run, f"conv_id {kind}, formatted string, ids array<int>, offsets array<int>, loss array<boolean>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def masked_text(formatted: str, offsets: list[int], loss: list[bool]) -> str:
    """The text under the mask, each character once although several tokens may share it."""
    out, done = [], 0
    for k, on in enumerate(loss):
        if on:
            a, b = max(done, offsets[2 * k]), offsets[2 * k + 1]
            if a < b:
                out.append(formatted[a:b])
                done = b
    return unescape("".join(out))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _util.slices(batches, ENCODED):
            out = []
            for text, offsets, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                turns, under = read_back(text), masked_text(text, offsets, loss)
                out.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), digest(under), len(text)))
            n, turns_sha, chars, loss_sha, long = zip(*out, strict=True) if out else ([],) * 5
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(turns_sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(long, pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("conv_id", "formatted", "offsets", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts are control strings."""
    rows = _util.only(_util.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{tricky}'), (-7L, 1L, 'assistant', '{tricky}') AS t(conv_id, turn, role, text)")
    return digests(format_chat(rows.unionByName(own), _util.tokenizer_path(DEFAULT)))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP2_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), each AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {sum(map(len, MARKS))})::BIGINT AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM each
"""
