"""Every registered query against its SQL twin (or at least: it runs and has rows)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402

from reelscope.registry import load  # noqa: E402

QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = check_oracle.duck(sf_dir)
    con.execute("SET TimeZone='UTC'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, note = check_oracle.compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
    assert ok, note

