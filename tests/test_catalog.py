"""Every query of the core with SQL gives the same rows on the smallest tables."""

import pytest
from oracle import SMALL, connect, same

from inkweave.plans import catalog

SLOW = {"classifier_zoo", "deepwalk", "deepwalk_evaluation", "document_vectors"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    same(catalog.queries()[name](spark, SMALL).toPandas(), duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0
