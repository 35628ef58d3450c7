"""The driver contract, and a few queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = ("agg_kpis", "win_current_consent", "match_score", "html_to_text", "dedup_components", "life_absence", "cv_blocks", "stream_ingest")


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) > 180 and set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    n, ok, why = compare(spark, connect(FOLDER), FOLDER, name)
    assert ok, why


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
