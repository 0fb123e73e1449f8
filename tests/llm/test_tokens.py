"""Operators 1, 2 and 5 against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from lodestone.llm import _util, bpe, chat, codec, token_counts

PATH = _util.tokenizer_path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'", "<|endoftext|>", "1", "ß", "😀", "\x1c", "\x85", "\xa0", "　", "!", "Zz", "ⅷ", "́", "\x00", "don't", "the"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(5)
    return ["", "a" * 30_000, " " * 300, *("".join(r.choice(PARTS) for _ in range(r.randint(0, 16))) for _ in range(3000))]


def test_encode_decode_equal_library(library):
    own = bpe.ByteBPE(PATH)
    for t in texts():
        ids = own.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t
        assert sum(map(own.count, own.segments(t))) == len(ids)
    assert own.decode(own.encode("é")[:1] + own.encode("x")) == library.decode(own.encode("é")[:1] + own.encode("x"), skip_special_tokens=False)


def rows(spark):
    some = [(k, t, "x", 1) for k, t in enumerate(texts()[:400])] + [(None, "the end", "x", 1), (7, None, None, None), (7, "again", "x", 2), (7, "again", "x", 2), (8, "ab " * 70_000, "x", 2)]
    return spark.createDataFrame(some, "doc_id long, text string, word string, block int")


def test_token_counts(spark, library):
    df = rows(spark).repartition(3)
    want = sorted(str((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512)) for r in df.collect())
    assert sorted(str(tuple(r)) for r in token_counts.token_counts(df, PATH).collect()) == want
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


def test_round_trip(spark, library):
    df = rows(spark)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append(str((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in codec.round_trip(df, PATH).collect()) == sorted(want)
    coded = codec.encode(df, PATH)
    assert sorted(map(str, (r.text for r in codec.decode(coded, PATH).collect()))) == sorted(r.text or "" for r in df.collect())
    assert codec.encode(df.limit(0), PATH).count() == 0


def test_chat_reversible_and_masked(spark):
    r = random.Random(3)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "s>", "[", "INST]", "é", "😀", " ", "\n", "ok", "(", "."]
    for _ in range(2000):
        a, b = ("".join(r.choice(parts) for _ in range(r.randint(0, 8))) for _ in range(2))
        turns = [("user", a), ("assistant", b), ("system", a), ("assistant", a)]
        text, spans, loss = chat.render(turns)
        assert chat.read_back(text) == turns
        e = chat.tokenizer(PATH).encode(text, add_special_tokens=False)
        assert chat.masked_text(text, [x for o in e.offsets for x in o], chat.mask(e.offsets, loss)) == b + a
    df = spark.createDataFrame([(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (1, 0, "user", "a", 0), (2, None, None, None, 0), (None, 0, "assistant", "x" * 50_000, 0)], "conv_id long, turn long, role string, text string, loss int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(df, PATH)).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == bpe.digest("user\na\nuser\na\nassistant\nb\n") and got[1].loss_sha256 == bpe.digest("b")
    assert got[2].n_turns == 1 and got[2].turns_sha256 == bpe.digest("\n\n") and got[2].loss_chars == 0
    assert got[None].loss_chars == 50_000
    assert chat.format_chat(df.limit(0), PATH).count() == 0


def test_op2_reads_planted_conversation(spark, sf):
    r = chat.op2_chat_format(spark, sf).where("conv_id = -7").collect()[0]
    t = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, bpe.digest(f"user\n{t}\nassistant\n{t}\n"), len(t), bpe.digest(t))
