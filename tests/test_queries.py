"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest

from quire.plans import catalogue, fixes

from .conftest import SF


def rows(columns, values, order):
    at = [columns.index(c) for c in order]
    return sorted(repr(tuple(v[i] for i in at)) for v in values)


@pytest.mark.parametrize("name", sorted(fixes.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = fixes.QUERIES[name](spark, SF)
    want = duck.execute(fixes.ORACLES[name])
    columns = [d[0] for d in want.description]
    order = sorted(columns)
    assert sorted(got.columns) == order
    assert rows(got.columns, [tuple(r) for r in got.collect()], order) == rows(columns, want.fetchall(), order)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["page", "ln", "pos", "box", "tag", "ratio"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_each_word_is_claimed_once_or_left_over(spark):
    words = catalogue._words(spark, SF)
    claimed = catalogue._claimed(spark, SF)
    assert claimed.count() == words.count() == claimed.select("page", "ln", "pos").distinct().count()
