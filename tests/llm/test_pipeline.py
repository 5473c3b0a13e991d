"""Every stage of the pipeline on its own input, against brute force."""

import duckdb
import pytest

import corpus_pipeline as cp
from motley.llm import quality_model, quality_rules
from motley.llm.common import table
from tests.llm.test_fuzzy_lines import brute as brute_lines
from tests.llm.test_simhash import brute_groups


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The input and output rows of each stage."""
    docs, out = table(spark, sf, "documents"), []
    for i, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns_and_rows(spark, sf, stages):
    columns = table(spark, sf, "documents").columns
    counts = [a.count() for _, a in stages]
    assert all(a.columns == columns for _, a in stages[:-1]) and counts[:4] == sorted(counts[:4], reverse=True)
    assert [r[0] for r in cp.STAGES] == ["quality classifier", "quality rules", "line dedup", "SimHash near-dedup",
                                         "best-fit packing"]


def test_classifier(spark, sf, stages):
    before, after = stages[0]
    want = quality_model.classify(before, table(spark, sf, "labels")).where("predicted = 1")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in want.collect())


def test_rules(stages):
    before, after = stages[1]
    documents = before.toPandas()  # noqa: F841  read by the SQL
    want = duckdb.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept").fetchall()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r[0] for r in want)


def test_lines(stages):
    before, after = stages[2]
    rows = {r.doc_id: r.text for r in before.collect()}
    want = {i: t for i, t in brute_lines(list(rows.items()), short=True).items() if t == rows[i] or t.split()}
    got = {r.doc_id: r for r in after.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_documents(stages):
    before, after = stages[3]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()], 3)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))


def test_odd_rows(spark, sf, tmp_path):
    """Null and repeated rows, empty texts and tables pass through every stage."""
    docs = table(spark, sf, "documents")
    odd = docs.limit(40).unionByName(docs.limit(5)).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (None, "a b c", "en", None, 5), (1, "", None, "s", 0), (2, None, "de", "s", None)], docs.schema))
    for i, rows in enumerate((odd, docs.limit(0))):
        folder = tmp_path / str(i)
        rows.coalesce(1).write.parquet(str(folder / "documents.parquet"))
        table(spark, sf, "labels").write.parquet(str(folder / "labels.parquet"))
        kept = cp.run(spark, str(folder)).count()
        assert 0 < kept <= 49 if i == 0 else kept == 0


def test_packing(stages):
    before, after = stages[4]
    got = after.toPandas()
    want = {r.doc_id: len(r.text.encode()) for r in before.collect()}
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert (got.groupby("bin").length.sum() == got.drop_duplicates("bin").set_index("bin").used.sort_index()).all()


def test_run(spark, sf, stages):
    cols = ["doc_id", "piece", "start", "length", "bin", "offset", "size", "used"]
    assert sorted(map(tuple, cp.run(spark, sf).select(cols).collect())) == sorted(map(tuple, stages[4][1].select(cols).collect()))
