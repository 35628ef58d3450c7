"""Token counts against the library, license scans against rules written out by hand."""

import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from laborlens.llm import licenses, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   ", "\n\t ", "Hello  World", "hello\u00a0world\u3000x\u2028y", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> <| endoftext |>",
    "don't we'll I'm THE'S 's", "É e\u0301 \u0301x İ Σ ς ß ŉ", "1234 12.5 a1b2c3", "x" * 5000, "ab " * 40000, "\x1c\x1d\x85 a\x0bb\x0cc", "😀😀 🇩🇪 日本語", "\u200d\ufeff",
]


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts_equal_the_library(make_docs, tmp_path):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("aB 'é\n\t1<|>\u00a0\u0301") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += texts[:20]  # repeated rows
    got = tokens.count_tokens(make_docs(texts), PATH, str(tmp_path / "cache"))
    rows = {r["doc_id"]: r for r in got.collect()}
    want = library(texts)
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert rows[i]["n_tokens"] == want[i], repr(text)
        assert rows[i]["n_bytes"] == len((text or "").encode())
        assert rows[i]["over_limit"] == (want[i] > 2048)


def test_cache_is_read_and_appended(spark, make_docs, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    tokens.count_tokens(make_docs(["one two", "one  two ", "three"]), PATH, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 2  # equal after normalising
    encoded = []
    real = tokens.encode_counts
    monkeypatch.setattr(tokens, "encode_counts", lambda df, path: encoded.append(df.count()) or real(df, path))
    got = tokens.count_tokens(make_docs(["three", "four", "one two"]), PATH, cache).collect()
    assert encoded == [1] and len(got) == 3
    assert spark.read.parquet(cache).count() == 3
    assert {r["tokenizer"] for r in spark.read.parquet(cache).collect()} == {tokens.file_digest(PATH)}


def test_a_stored_count_is_taken_for_its_tokenizer_only(spark, make_docs, tmp_path):
    cache = str(tmp_path / "cache")
    docs = make_docs(["one two"])
    digest = docs.select(tokens.F.sha2(tokens.normalised(docs["text"]), 256).alias("d")).first()["d"]
    spark.createDataFrame([(digest, "other", 77)], tokens.CACHE).write.parquet(cache)
    assert tokens.count_tokens(docs, PATH, cache).first()["n_tokens"] == 2
    spark.createDataFrame([(digest, tokens.file_digest(PATH), 99)], tokens.CACHE).write.mode("append").parquet(cache)
    assert tokens.count_tokens(docs, PATH, cache).first()["n_tokens"] == 99


def test_empty_table(make_docs, tmp_path):
    assert tokens.count_tokens(make_docs([]), PATH, str(tmp_path / "cache")).count() == 0


def test_memo_generations():
    counter = tokens.WordCounter(PATH)
    texts = [f"word{i} again{i % 7}".encode() for i in range(500)]
    old, tokens.MEMO_WORDS = tokens.MEMO_WORDS, 50
    try:
        got = [counter.counts([t])[0] for t in texts * 2]
    finally:
        tokens.MEMO_WORDS = old
    assert got == library([t.decode() for t in texts]) * 2


def test_license_rules(make_docs):
    long = "word. " * 5000
    texts = [
        "Licensed under the Apache License, Version 2.0.\nmore", "text\nReleased under the MIT License.", "All  RIGHTS reserved!", None, "", "nothing here",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction.\nfiller\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied.",
        "The software is provided as is without warranty of any kind, express or implied. Permission is hereby granted, free of charge, to any person obtaining a "
        "copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        long + "\nLicensed under CC BY-NC 4.0.\n" + long, "Licensed under CC BY-NC 4.0", "we were not licensed under the apache license version 2.0 at all",
    ]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(make_docs(texts)).collect()}
    assert [got[i]["license"] for i in range(len(texts))] == [
        "Apache-2.0", "MIT", "proprietary", None, None, None, "MIT-text", None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None,
    ]
    assert got[7]["sentence_ids"] == ["mit_asis", "mit_grant"] and got[7]["licenses"] == []


def test_known_sentences_are_in_normal_form(spark):
    df = spark.createDataFrame([(s,) for s in licenses.SENTENCES], "s string")
    assert [r[0] for r in df.select(licenses.normal_sentence(df["s"])).collect()] == list(licenses.SENTENCES)
    used = {i for _, ids in licenses.RULES for i in ids}
    assert used <= set(licenses.SENTENCES.values())


def test_license_order_and_own_rules(make_docs):
    known = {"alpha one": "a", "beta two": "b"}
    rules = (("AB", ("a", "b")), ("B", ("b",)))
    got = licenses.scan_licenses(make_docs(["Alpha one. x. Beta two.", "beta two. alpha one", "alpha one"]), known=known, rules=rules)
    assert [r["licenses"] for r in got.orderBy("doc_id").collect()] == [["AB", "B"], ["B"], []]
    with pytest.raises(ValueError):
        licenses.scan_licenses(make_docs(["x"]), known={"a": "bad;id"})
    assert licenses.scan_licenses(make_docs([])).count() == 0
