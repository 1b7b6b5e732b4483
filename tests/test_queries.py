"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import decimal
import math

import pytest
from conftest import DATA

from corpusloom.plans import ORACLE, QUERIES


def shown(rows):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float, decimal.Decimal)):
            return repr(round(float(v), 6) + 0.0)
        return str(v)

    return sorted("|".join(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*order).collect()]
    theirs = duck.execute(f"select {', '.join(order)} from ({ORACLE[name]})").fetchall()
    assert shown(ours) == shown(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
