"""Every registered query against its SQL counterpart on the same tables."""

import math

import pytest

from sitegauge import catalog

QUERIES, SQL = catalog.load()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def sorted_rows(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, duck):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine = sorted_rows([row[c] for c in columns] for row in df.collect())
    assert mine, "no rows"
    if name not in SQL:
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted_rows([row[i] for i in at] for row in cursor.fetchall())


def test_sql_names_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
