"""Every query of this subpackage on the smallest test data, against its SQL where it has one."""

import os

import pytest

import compare
from tidende.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data absent")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf, name):
    assert compare.compare(spark, sf, name).startswith("ok")


def test_columns_of_the_found(spark, sf):
    want = {"p2_found": ["doc_id"], "p5_found": ["doc_id", "start_char", "end_char"], "p6_found": ["mention_a", "mention_b"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "lang"]}
    for name, columns in want.items():
        rows = queries.QUERIES[name](spark, sf)
        assert rows.columns == columns
        found = [tuple(map(str, r)) for r in rows.collect()]
        assert found and len(found) == len(set(found))
