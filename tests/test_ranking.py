"""Order statistics and running totals against plain sorting, also with a hot value."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sievewell.operators import ranking as rk
from pyspark.sql import functions as F


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("hot", [0, 4000])
def test_values_at_ranks(spark, hot, monkeypatch):
    monkeypatch.setattr(rk, "_BAND_ROWS", 50)
    rnd = random.Random(1)
    values = [rnd.gauss(0, 10) for _ in range(8000)] + [3.25] * hot
    want = sorted(values)
    ranks = [0, 1, 17, len(want) // 3, len(want) // 2, len(want) - 2, len(want) - 1]
    assert rk.values_at_ranks(frame(spark, values + [None]), "v", ranks) == [want[r] for r in ranks]


def test_rank_out_of_range(spark):
    with pytest.raises(ValueError):
        rk.values_at_ranks(frame(spark, [1.0]), "v", [1])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=40))
def test_quantiles_match_the_inclusive_method(spark, values):
    want = statistics.quantiles(values, n=4, method="inclusive")
    got = rk.exact_quantiles(frame(spark, values), "v", [0.25, 0.5, 0.75])
    assert got == pytest.approx(want)


def test_quantiles_of_nothing(spark):
    assert rk.exact_quantiles(frame(spark, [None]), "v", [0.5]) == [None]
    assert rk.discrete_quantile(frame(spark, []), "v", 0.5) is None


def test_discrete_quantile_is_an_element(spark):
    assert rk.discrete_quantile(frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), "v", 0.25) == 2.0


def test_cut_points_cut_inside_ties(spark, monkeypatch):
    monkeypatch.setattr(rk, "_BAND_ROWS", 20)
    data = [(1 if i % 3 else 2, i * 7 % 1000, i) for i in range(900)]
    df = spark.createDataFrame(data, "a int, b int, c int")
    order = ["a", "b", "c"]
    for rank in (1, 299, 300, 650):
        point = rk.cut_points(df, order, [rank])[0]
        assert df.where(rk.before(order, point)).count() == rank


@pytest.mark.parametrize("block_rows", [1_000_000, 10])
def test_running_totals(spark, block_rows):
    n = 500
    df = spark.range(n).select((F.col("id") * 37 % n).alias("k"), (F.col("id") % 5).alias("x"))
    got = rk.running_totals(df, "k", {"total": F.col("x")}, 7, block_rows).orderBy("k").collect()
    by_k = {r["k"]: r["x"] for r in df.collect()}
    run = 0
    for r in got:
        run += by_k[r["k"]]
        assert r["total"] == run


def test_hash_row_numbers_are_a_numbering(spark):
    df = spark.range(300).withColumnRenamed("id", "key")
    numbers = [r["row_number"] for r in rk.hash_row_numbers(df, "key", 1).collect()]
    assert sorted(numbers) == list(range(300))


def test_quantiles_of_many_groups_at_once(spark):
    rnd = np.random.default_rng(3)
    g = np.concatenate([np.arange(10_000).repeat(3), np.full(60_000, 77)])  # one group holds most rows
    v = np.concatenate([rnd.normal(size=30_000), rnd.choice([1.5, 1.5, 1.5, -2.0, 9.0], 20_000), rnd.normal(size=40_000)])
    pdf = pd.DataFrame({"g": g, "v": v}).sample(frac=1, random_state=1)
    df = spark.createDataFrame(pdf).selectExpr("CASE WHEN g = 5 THEN NULL ELSE cast(g AS string) END AS g", "CASE WHEN g = 6 THEN NULL ELSE v END AS v")
    ps = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for band in (1_000_000, 500):
        got = {r["g"]: r for r in rk.grouped_quantiles(df, "g", "v", ps, band_rows=band).collect()}
        assert len(got) == 10_000 and got["6"]["n"] == 0 and got["6"]["p50"] is None
        for name, some in pdf.groupby("g"):
            if name != 6:
                row = got[None if name == 5 else str(name)]
                assert row["n"] == len(some) and [row[k] for k in ps] == pytest.approx(list(np.quantile(some["v"], list(ps.values()))), abs=1e-12)


def test_a_value_that_repeats_ends_the_search(spark):
    df = spark.range(3000).selectExpr("'a' AS g", "1.0D AS v")
    assert [tuple(r) for r in rk.grouped_quantiles(df, "g", "v", {"p": 0.5}, band_rows=10).collect()] == [("a", 3000, 1.0)]
    assert rk.grouped_quantiles(df.where("false"), "g", "v", {"p": 0.5}).collect() == []
