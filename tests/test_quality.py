"""Rules, keys and standardising traps."""

import pytest

from conftest import rows
from pyspark.sql import functions as F
from sievewell.operators import profile as pr
from sievewell.operators import quality as q
from sievewell.operators import standardize as st

SCHEMA = "drug_id string, drug_name string, avg_mass double, description string, indication string, mechanism string, toxicity string, ingest_dt string"


def row(i="DB1", name="n", mass=10.0, ind="long enough text", mech="long enough text", dt="2025-01-01"):
    return (i, name, mass, "d", ind, mech, None, dt)


def failed(spark, *data):
    df = spark.createDataFrame(list(data), SCHEMA)
    return [r["failed_rules"] for r in q.evaluate_rules(df, q.default_rules(df, None)).orderBy("drug_id", "drug_name").collect()]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="toxicity"):
        q.require_columns(spark.createDataFrame([row()], SCHEMA).drop("toxicity"))


def test_clean_row_passes(spark):
    assert failed(spark, row()) == [[]]


@pytest.mark.parametrize(
    "bad, rule",
    [
        (row(name="  "), "name_missing"),
        (row(name=None), "name_missing"),
        (row(i="X1"), "id_pattern"),
        (row(mass=None), "mass_invalid"),
        (row(mass=0.0), "mass_invalid"),
        (row(mass=1e6), "mass_invalid"),
        (row(ind="short"), "text_short"),
        (row(dt=" "), "ingest_missing"),
    ],
)
def test_each_rule(spark, bad, rule):
    assert failed(spark, bad) == [[rule]]


def test_three_valued_rules(spark):
    # TR2: a null id is no bad pattern; a null text is short only through the other one
    assert failed(spark, row(i=None)) == [["id_missing"]]
    assert failed(spark, row(ind=None)) == [[]]
    assert failed(spark, row(ind=None, mech="short")) == [["text_short"]]


def test_null_key_rows_count_as_good(spark):
    # TR3, and the strict form
    df = spark.createDataFrame([row(i=None, name=None), row("DB2"), row("DB3", mass=-1.0)], SCHEMA)
    checked = q.evaluate_rules(df, q.default_rules(df, None))
    assert rows(q.quality_summary(checked)) == [(3, 2, 1)]
    assert rows(q.quality_summary(checked, strict_null_keys=True)) == [(3, 1, 2)]
    keyed = q.drop_listed(checked, q.failing_keys(checked))
    assert keyed.count() == 2 and keyed.where("drug_id IS NULL").count() == 1


def test_hot_duplicate_key(spark):
    df = spark.createDataFrame([row("DB7")] * 300 + [row(f"DB{i}") for i in range(100, 700)], SCHEMA)
    checked = q.evaluate_rules(df, q.default_rules(df, None))
    assert rows(q.rule_summary(checked)) == [("id_duplicate", 300)]
    good, bad = q.split_good_bad(checked)
    assert good.count() + bad.count() == 900


def test_outlier_fences_need_ten_values(spark):
    nine = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    assert q.iqr_bounds(nine, "v") is None
    ten = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert q.iqr_bounds(ten, "v") == pytest.approx((-4.5, 13.5))


def test_null_mass_falls_into_the_last_bin(spark):
    # TR1
    df = spark.createDataFrame([(None,), (99.9,), (100.0,), (500.0,), (500.1,)], "m double")
    assert rows(pr.bin_counts(df, "m")) == [("100-500", 2), ("<100", 1), (">500", 2)]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    got = pr.histogram(df, "v", 4).orderBy("bin").collect()
    assert [r["row_count"] for r in got] == [0, 0, 2, 0]
    assert got[0]["lower"] == 1.5 and got[-1]["upper"] == 2.5


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None), (None, 1, "n"), (None, 0, "m")], "k string, o int, v string")
    assert rows(st.dedupe(df, "k", ["o"])) == rows(spark.createDataFrame([("a", 1, "y"), ("b", 5, None), (None, 0, "m")], df.schema))


def test_alias_fill_keeps_the_untrimmed_value(spark):
    df = spark.createDataFrame([(" ", " m "), ("t", "m"), (None, None)], "toxicity string, toxicities string")
    got = [r["toxicity"] for r in st.coalesce_aliases(df).collect()]
    assert got == [" m ", "t", None]


def test_messages(spark):
    # TR22: the default applies only where the key is absent
    lines = ['{"id":1,"text":"hey"}', '{"id":2,"text":"x","source":null}', '{"id":3}', "{bad", '{"id":4,"text":null}', '{"id":5,"text":7}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = st.clean_messages(df, "value", F.lit("now"))
    assert rows(got, "id", "source", "text", "text_length") == [("1", "unknown", "hey", 3), ("2", None, "x", 1)]


def test_summary_rows(spark):
    df = spark.createDataFrame([(1, "m", "", 10), (2, None, "r", 20), (3, "m", "r", 30), (4, "", "", 40)], "line int, metric string, rule string, n int")
    assert rows(q.summary_rows(df, "line"), "summary_key", "n") == [("m", 30), ("r", 20), ("row", 40)]


def test_report_lists_counts_and_samples(spark):
    df = spark.createDataFrame([row("DB2"), row("DB3", mass=-1.0)], SCHEMA)
    checked = q.evaluate_rules(df, q.default_rules(df, None))
    # TR18: the archive path is shown as given, whatever was moved
    text = q.report_markdown(checked, ["drug_id", "drug_name"], "2025", {"Archive": "/a/bad_1"}, ["drug_id"])
    assert "Good rows: **1**" in text and "| mass_invalid | 1 |" in text and "`/a/bad_1`" in text
