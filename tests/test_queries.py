"""Every registered query with an oracle gives DuckDB's rows, and some rows."""

import pytest
from conftest import DATA

import __spark_entry__ as entry
from clausewise.plans import registry


def rows(table):
    names = sorted(table.column_names)
    show = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return names, sorted(zip(*[[show(v) for v in table.column(c).to_pylist()] for c in names], strict=True))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = rows(entry.queries()[name](spark, f"{DATA}/sf0.001").toArrow())
    assert got == rows(duck.sql(registry.oracle_sql()[name]).to_arrow_table())
    assert got[1]


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc_id", "traffic_light", "template_id", "score", "collision", "n_candidates"]
