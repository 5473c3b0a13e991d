"""The queries of learned estimates grow all their trees: 100 rounds at a rate of 0.1, as deep as the library's own."""

import datetime
import inspect

import pytest

from __spark_entry__ import queries
from motley.plans import evaluate as ev
from motley.plans import learners as ml


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A few parts, suppliers, orders and lines."""
    path, day = str(tmp_path_factory.mktemp("small")), datetime.datetime(2015, 5, 1)
    tables = {
        "part": ([(i, f"{'red blue old new'.split()[i % 4]} {'nut bolt pin'.split()[i % 3]}", f"Brand#{i % 3}") for i in range(12)],
                 "p_partkey bigint, p_name string, p_brand string"),
        "supplier": ([(i, i) for i in range(14)], "s_suppkey bigint, s_nationkey int"),
        "orders": ([(i, 0, "FO"[i % 2], day.replace(year=2010 + i % 5)) for i in range(40)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp"),
        "lineitem": ([(i % 40, i % 12, i % 14, i // 40, float(100 + 10 * (i % 12) + i % 7), "R") for i in range(200)],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_returnflag string"),
        "embeddings": ([(i, [float(i % 3), 1.0, float(i)]) for i in range(6)], "vec_id bigint, embedding array<float>"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


class Asked(Exception):
    pass


@pytest.mark.parametrize("name, module, rates", [("boosted_quantile", ml, [0.1]), ("cv_errors_learned_quantile", ev, [0.1] * 4)])
def test_quantiles_take_a_hundred_rounds(spark, small, monkeypatch, name, module, rates):
    said, signature = {}, inspect.signature(module.fit_many)

    def fit(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        said.update(bound.arguments)
        raise Asked

    monkeypatch.setattr(module, "fit_many", fit)
    with pytest.raises(Asked):
        queries()[name](spark, small).collect()
    assert (said["loss"], said["rounds"], said["depth"], said["rates"]) == ("quantile", 100, 3, rates)


def test_salaries_take_a_hundred_rounds(spark, small, monkeypatch):
    fitted, fit = [], ml.boosted_salary
    monkeypatch.setattr(ml, "boosted_salary", lambda *args, **options: fitted.append(fit(*args, **options)) or fitted[-1])
    queries()["boosted_salary"](spark, small).collect()
    trees = fitted[0].stages[-1]
    assert trees.getNumTrees == 100 and (trees.getMaxDepth(), trees.getStepSize()) == (5, 0.1)
