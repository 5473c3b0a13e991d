"""Byte-level BPE and licence scans against plain versions; the classifier on rows held out."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from motley.llm import bpe, license_scan, quality_model, queries
from motley.llm.common import table

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, P.PATTERN)
SCANNER = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab \n\x1c\x85\u00a0\u180eé日😀'sé5.,", max_size=60)))
def test_ids(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 5_000 + "x", "ab" * 9_000, "\n" * 3_000, "日" * 4_000])
def test_long_pieces(text):
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == PLAIN.encode_ordinary(text)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(RANKS, P.PATTERN)
    text = "one two three four five one two three " * 3
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == PLAIN.encode_ordinary(text) and len(codec.known) <= 3


def test_encode_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in queries.op2_bpe(spark, sf).collect():
        ids = PLAIN.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_encode_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "", 4), (2, "hello", 5)], "doc_id long, text string, ids int")
    out = bpe.encode(docs, RANKS, P.PATTERN)
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in out.collect()) == [
        (0, 0, b""), (1, 0, b""), (1, 0, b""), (2, 1, b"hello")]
    back = bpe.decode(out.select("doc_id", "ids"), RANKS)
    assert sorted(bytes(r.decoded) for r in back.collect()) == [b"", b"", b"", b"hello"]
    assert bpe.encode(docs.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, {b"a": 0}, P.PATTERN)


def plain_base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for label, p in license_scan.PHRASES for i in range(len(words))
             if words[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in found})))


def of(row):
    return row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]


def test_phrases():
    rng = random.Random(5)
    words = "cc by nc sa all rights reserved general public license gnu the mit x licensed under apache 2 0 copyright é".split()
    for _ in range(500):
        text = rng.choice([" ", "-", ", "]).join(rng.choice(words).title() for _ in range(40))
        assert of(SCANNER.scan(text)) == plain_base(text)


def test_matching_statistics():
    rng, plain = random.Random(7), ["abcbc", "bcbca", "aab", "abcbc"]
    auto = license_scan.Automaton([list(t) for t in plain])
    for _ in range(500):
        s = "".join(rng.choice("abc") for _ in range(12))
        for i, (state, n) in enumerate(auto.run([auto.ids[c] for c in s])):
            assert n == max(k for k in range(i + 2) if any(s[i + 1 - k:i + 1] in t for t in plain))
            assert set(auto.ends[state]) == {(j, e) for j, t in enumerate(plain) for e in range(n, len(t) + 1)
                                             if n and t[e - n:e] == s[i + 1 - n:i + 1]}


def test_templates():
    for label, text in license_scan.TEMPLATES:
        words = license_scan.words_of(text)
        found = SCANNER.scan("some words before " + text + " and after")
        assert label in found["labels"].split(",") and any(
            s["label"] == label and (s["start"], s["end"]) == (3, 3 + len(words)) for s in found["spans"])
        if len(words) > 12:  # a changed word splits the match, the chain joins it
            words[len(words) // 2] = "changed"
            spans = [s for s in SCANNER.scan(" ".join(words))["spans"] if s["label"] == label]
            assert any(s["covered"] >= 1 - 1.5 / len(words) for s in spans)
    assert SCANNER.scan("the software is free to use by any person and the copyright of it is here")["labels"] == ""


def test_scan_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = queries.op10_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and all(of(r) == plain_base(texts[r.doc_id]) for r in rows)


def test_scan_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3), (1, None, 3), (None, "", 4), (2, "CC-BY " * 30_000, 5)], "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.score) for r in license_scan.scan(docs).collect())
    assert got == [(0, 0, 0, None, None, "", 0.0), (1, 0, 0, None, None, "", 0.0), (1, 0, 0, None, None, "", 0.0),
                   (2, 60_000, 30_000, 0, 59_998, "cc-by", 1.0)]
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_density():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(60, 3)) @ rng.normal(size=(3, 3)) + k for k in range(2)]
    model = quality_model.Model.of_moments([len(a) for a in x], [a.sum(0) for a in x], [a.T @ a for a in x], 0.3, 0.1)
    own = [np.cov(a.T, bias=True) for a in x]
    for k in range(2):
        mixed = 0.7 * own[k] + 0.3 * (own[0] + own[1]) / 2
        cov = 0.9 * mixed + 0.1 * np.trace(mixed) / 3 * np.eye(3)
        assert np.allclose(np.linalg.inv(model.inverse[k].T @ model.inverse[k]), cov)
        assert np.isclose(model.constant[k], np.log(0.5) - np.linalg.slogdet(cov)[1] / 2)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_model.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    seen = out.join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert (seen.predicted == seen.quality).mean() > 0.97 and out.where("score NOT BETWEEN 0 AND 1").count() == 0
    ids = [r.doc_id for r in out.where("held_out").select("doc_id").collect()]
    import zlib
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)


def test_classify_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "", 2.0), (2, "word " * 60_000, 3.0)],
                                 "doc_id long, text string, score double")
    labels = table(spark, sf, "labels")
    none = quality_model.classify(docs, labels.limit(0)).collect()
    assert len(none) == 4 and all(r.score == 1.0 and r.predicted == 1 for r in none)
    learnt = table(spark, sf, "documents").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    got = quality_model.classify(learnt, labels).where("doc_id IS NULL OR doc_id = 1 AND score = 0").collect()
    assert all(r.score == 0 and not r.held_out for r in got) and len(got) >= 1
    assert quality_model.classify(docs.limit(0), labels).count() == 0
    assert quality_model.keep_good(docs, labels.limit(0)).columns == docs.columns
