"""The pipeline against brute force, stage by stage, and with empty tables."""

import hashlib

from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import _util, quality

from .test_lines import brute as brute_lines
from .test_minhash import brute as brute_groups
from .test_quality import brute as brute_stats


def test_stages(spark, sf):
    docs = _util.table(spark, sf, "documents")
    columns = docs.columns
    rules = quality.fit(docs, _util.table(spark, sf, "labels"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = _util.materialize(stage(spark, docs, sf))
        out[name] = (before, [r.asDict() for r in docs.collect()])
        if name != "BPE encoding":
            assert docs.columns == columns
    before, after = out["quality rules"]
    want = []
    for r in before:
        n, chars, symbols, dup, rep = brute_stats(r["text"])
        x = {"n_words": n, "mean_word": chars / max(n, 1), "symbols_a_word": symbols / max(n, 1), "dup_lines_a_word": dup / max(n, 1), "repeated_share": rep / max(n, 1)}
        if n >= 50 and 100 * rep <= 50 * n and not any(all(c.holds(x) for c in rule) for rule in rules):
            want.append(r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(want) and len(want) < len(before)
    before, after = out["line dedup"]
    first = brute_lines([(r["doc_id"], r["text"]) for r in before])
    from lodestone.llm.lines import normal_line

    texts = {}
    for r in before:
        kept = [x for k, x in enumerate(r["text"].split("\n")) if not normal_line(x) or first[normal_line(x)] == (r["doc_id"], k)]
        if len(kept) == len(r["text"].split("\n")) or "".join(kept).strip():
            texts[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in after} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = out["MinHash near-dedup"]
    group = brute_groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if group.get(r["doc_id"], r["doc_id"]) == r["doc_id"])
    before, after = out["mixing sources"]
    assert {tuple(r.values()) for r in after} <= {tuple(r.values()) for r in before} and after
    before, after = out["BPE encoding"]
    t = Tokenizer.from_file(_util.tokenizer_path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r["ids"] == t.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_empty(spark, sf):
    docs = _util.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = _util.materialize(stage(spark, docs, sf))
        assert docs.count() == 0
