import os

import pytest

from spindrift.llm import queries as Q
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
COLUMNS = {
    "p1_found": ["doc_id"], "p2_found": ["doc_id", "pos"], "p3_found": ["doc_id", "pos", "lang"], "p4_found": ["doc_id", "pos", "line_no"], "p5_found": ["doc_id", "term"],
    "p6_found": ["doc_id", "pos"], "p7_found": ["link_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, Q.queries()[name], Q.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = Q.queries()[name](spark, FOLDER)
    assert df.columns == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
