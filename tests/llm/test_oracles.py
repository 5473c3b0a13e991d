"""Operators that SQL can express, against DuckDB, on the tables and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from motley.llm import perspectives, quality_rules, queries, topk, url_rules
from tests.compare import connect, difference, rows_of, run


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_whole_table(spark, sf, name):
    _, problem = run(spark, connect(sf), name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert problem is None


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert difference(sorted(names), rows_of(df.columns, [tuple(r) for r in df.collect()]),
                      rows_of(names, result.fetchall())) is None


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "a", "one two", "one two three one two three", "x\nx\n\nx \n", "the of | and\n|\n# $ ab!! CD#",
             "a b a b a b a b", "é\u00a0ü 日本 #\u2003x", "x" * 300_000, "w1 w2 w3 " * 30_000, "\x0b\x0c\r same line\r\nsame line\r\n"]
    rows = [(i % 9, t, 5, "y") for i, t in enumerate(texts)] + [(None, "one two three " * 20, 1, "z")] * 2
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    same(quality_rules.apply_rules(documents).drop("failed"), quality_rules.oracle(), documents=documents)
    assert quality_rules.keep_good(documents).columns == documents.columns
    assert quality_rules.apply_rules(documents.limit(0)).count() == 0


def test_odd_urls(spark):
    urls = [None, "", "no scheme/net/", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "x://example.net/en/1", "x://example.net/en",
            "x://notexample.net/en/", "http://www.Example.com/de/", "http://example.com/De/", "a://b.org/fr/?q", "a://org/fr/x/y",
            "http://x.net:80/", "http://?q", "://net/a", "a://b://c.net/", "http://.net/", "http://net./", "http://a\nb.net/\n?",
            "http://" + "a." * 400 + "net/" + "p/" * 3_000]
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u in enumerate(urls)] + [(None, "http://net/", "k", 1)] * 3,
                                  "page_id long, url string, host string, rule int")
    same(url_rules.judge(pages), url_rules.oracle(), pages=pages)
    assert url_rules.judge(pages.limit(0)).count() == 0
    none = url_rules.judge(pages, url_rules.rule_table(spark, [("block", None, "/")]))
    assert none.where("rule IS NULL AND verdict = 'allow'").count() == len(urls) + 3


def test_rule_precedence(spark):
    rules = [("allow", "b.c", "/x"), ("block", "b.c", "/x"), ("block", "c", "/xyz"), ("allow", "a.b.c", "/"), ("block", "c", "")]
    pages = spark.createDataFrame([(1, "h://a.b.c/xy"), (2, "h://a.b.c/xyz"), (3, "h://z.b.c/xq"), (4, "h://c"), (5, "h://d/")],
                                  "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, url_rules.rule_table(spark, rules)).collect()}
    assert got == {1: ("a.b.c/", "allow"), 2: ("a.b.c/", "allow"), 3: ("b.c/x", "block"), 4: ("c", "block"), 5: (None, "allow")}


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 13)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "TILE", 4)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rows = [(i * 5 % 140 - 40, [float((i * 7 + j * 3) % 5 - 2) / 3 for j in range(4)]) for i in range(28)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]
    rows += [(300, None), (320, [1.0, None, 0.0, 0.0]), (340, [float("nan"), 0.0, 0.0, 0.0]),
             (360, [float("-inf"), 0.0, 0.0, 0.0])]
    embeddings = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(4)
    same(topk.search(embeddings), topk.oracle(), embeddings=embeddings)
    assert topk.search(embeddings.limit(0)).count() == 0
    assert topk.search(embeddings.where("vec_id = 200")).count() == 0
    twice = topk.search(embeddings.where("vec_id IN (200, 201)").unionAll(embeddings.where("vec_id = 201")))
    assert [(r.rank, r.vec_id) for r in twice.orderBy("rank").collect()] == [(1, 201), (2, 201)]


def test_repeated_ids_are_rows(spark, monkeypatch):
    for name, size in (("SHARD", 13), ("BLOCK", 3), ("TILE", 4), ("FAN_IN", 2)):
        monkeypatch.setattr(topk, name, size)
    rows = [(i % 60, [((i * 7 + j * 3) % 11 - 5) / 4 for j in range(3)]) for i in range(70)]
    rows += [rows[20], rows[20], rows[40], rows[33]]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    z = [(i, [int(64 * x // 1) for x in v]) for i, v in rows]
    want = []
    for n, (q, v) in enumerate(z):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(z) if m != n)[:4]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.search(data, k=4).collect()) == sorted(want)


@pytest.mark.parametrize("most", [1.0, 1e6, 2e7])
def test_exact_scores(spark, most):
    rows = [(i, [most * (i % 7 - 3) / 3, most * (i % 5) / 7]) for i in range(60)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    z = {i: [int(__import__("math").floor(64 * x)) for x in v] for i, v in rows}
    got = {}
    for r in topk.search(data, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(z[q], v)), i) for i, v in z.items() if i != q)[:3]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_odd_turns(spark, monkeypatch):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "ann", "<|im_end|>\nx"),
            (1, None, None, ""), (2, 0, "system", "alone"), (None, 5, "ann", "é日"), (None, 5, "bob", "é日"),
            (3, 0, "ann", "y" * 100_000), (3, 1, "bob", "short"), (3, 2, "ann", "z")]
    conversations = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn int, role string, text string, start int, own string")
    out = perspectives.render(conversations)
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    same(out.withColumn("mask_spans", spans).drop("mask"), perspectives.oracle(), conversations=conversations)
    got = {(r.conv_id, r.perspective, r.chunk): r for r in out.collect()}
    ann = got[1, "ann", 0]
    assert [ann.text[a:b] for a, b in ann.mask] == ["hi<|im_end|>", "<| im_end|>\nx<|im_end|>"]
    assert ann.text.startswith("<|im_start|>user name=unknown\n<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n")
    assert not any(k[0] == 2 for k in got) and sorted(k[2] for k in got if k[:2] == (3, "bob")) == [0, 3]
    assert perspectives.render(conversations.limit(0)).count() == 0
