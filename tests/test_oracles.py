"""Every registered query with an SQL twin gives the same rows in DuckDB."""

import pytest

from compare import compare, duck
from conftest import SF
from sievewell.plans import plans

WITH_SQL = {n: p for n, p in plans().items() if p.sql}
# Trained models are held to their floor on tables large enough to learn from.
TRAINED = ["forest_text_classifier", "logistic_text_classifier"]
LARGER = "/root/testdata/sf0.01"
ROWS_ONLY = sorted(n for n, p in plans().items() if not p.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", TRAINED)
def test_trained_models_reach_their_floor(spark, name):
    assert compare(plans()[name].run(spark, LARGER), duck(LARGER), plans()[name].sql) == ""


@pytest.mark.parametrize("name", sorted(set(WITH_SQL) - set(TRAINED)))
def test_same_as_sql(spark, con, name):
    p = WITH_SQL[name]
    verdict = compare(p.run(spark, SF), con, p.sql)
    # Some faults are too rare for the smallest tables: an empty result must be empty on both sides.
    assert verdict in ("", "EMPTY"), verdict


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert plans()[name].run(spark, SF).count() > 0
