from __future__ import annotations

import pytest

from granary.plans import catalogue
from tests.queries import FOLDER, compare

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_gives_what_its_sql_gives(spark, name):
    compare(spark, catalogue.queries()[name], catalogue.oracle_sql().get(name))


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
