from __future__ import annotations

import pytest

from granary.llm import queries as Q
from tests.queries import FOLDER, compare

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_gives_what_its_sql_gives(spark, name):
    compare(spark, Q.queries()[name], Q.oracle_sql().get(name))
