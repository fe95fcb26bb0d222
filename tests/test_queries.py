"""Every registered query outside the training-data subpackage runs, and equals its SQL where it has one."""

import math

import duckdb
import pytest

from vqspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def rows(found):
    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 4) if isinstance(x, float) else str(x) if isinstance(x, list) else x

    return sorted((tuple(map(cell, r)) for r in found), key=str)


def same(a, b):
    return len(a) == len(b) and all(len(x) == len(y) and all(u == v or isinstance(u, float) and isinstance(v, (int, float)) and math.isclose(u, v, abs_tol=2e-4) for u, v in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = rows(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))
    if name in registry.ORACLE_SQL:
        wanted = rows(duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({registry.ORACLE_SQL[name]})").fetchall())
        assert same(found, wanted)
    else:
        # What SQL can't follow has tests of its own (test_kinds, test_vectors); here: rows, and no value is missing or not a number.
        assert found and all(v is not None and v != "nan" for r in found for v in r)
