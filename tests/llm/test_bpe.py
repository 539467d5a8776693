import hashlib
import random

import pytest

from parvis.llm import bpe, token_counts

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
ODD = [
    None, "", "  ", "Hello's I'LL can't 12345 ΑΣ Σ İx", "a <|endoftext|> b<|startoftext|>c <|endof", "a\x1cb\x85c　d", "x" * 3000,
    "naïve é é \U0001F600 ​", "中文字符 ١٢٣ Ⅷ ²", "\x00 a\x00b", "'s't're", "same", "same",
]


def library(texts):
    model = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = []
    for t in texts:
        ids = model.encode(t or "", add_special_tokens=False).ids
        rows.append((ids, model.decode(ids, skip_special_tokens=False)))
    return rows


def test_same_as_library(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdefgh 'stn1é!ΣÀ\n") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = bpe.encoded(docs)
    got = {r.doc_id: r for r in rows.select("doc_id", "ids", "decoded", *[c.alias(k) for k, c in bpe.digests(rows).items()]).collect()}
    for i, (ids, decoded) in enumerate(library(texts)):
        assert got[i].ids == ids and got[i].decoded == decoded and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table_and_nulls(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded(docs).collect() == []
    assert token_counts.context_report(token_counts.length_histogram(docs)).collect() == []


def test_context_report(spark):
    texts = ["", None, "one", "one two", "one two", "three four five six", "w " * 1500, "w " * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lengths = [len(ids) for ids, _ in library(texts)]
    report = token_counts.context_report(token_counts.length_histogram(docs))
    rows = {r.n_tokens: r for r in report.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for limit, r in rows.items():
        assert r.docs == lengths.count(limit)
        assert r.docs_up_to == sum(n <= limit for n in lengths) and r.docs_over == sum(n > limit for n in lengths)
        assert r.tokens_up_to == sum(n for n in lengths if n <= limit) and r.tokens_over == sum(n for n in lengths if n > limit)
        assert r.truncated_total == sum(min(n, limit) for n in lengths)
        assert r.dropped_tokens == sum(lengths) - r.truncated_total and r.total_tokens == sum(lengths)
    quantiles = {r.rank: r.n_tokens for r in token_counts.length_quantiles(report).collect()}
    assert quantiles[0.5] == sorted(lengths)[3] and quantiles[0.99] == max(lengths)
    marked = {q: r.n_tokens for r in report.select("n_tokens", token_counts.quantile_of().alias("ranks")).collect() for q in r.ranks}
    assert marked == quantiles


def test_parts_of_a_batch(spark):
    """A batch is worked in parts, also where all texts of a part are empty."""
    texts = [None] * 300 + ["", "one two"] * 300 + [""] * 600 + ["last"]
    rows = bpe.encoded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).collect()
    assert [(r.ids, r.decoded) for r in sorted(rows, key=lambda r: r.doc_id)] == library(texts)
