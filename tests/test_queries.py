"""Every registered query of the engine's own operators against its SQL twin, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from lexarium import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


#: Queries that SQL can't say, and the rows they give at least on the smallest tables.
WITHOUT_TWIN = {"chunk_overlap": 200, "visible_text": 1, "redacted_documents": 200, "converted_pages": 200, "hashed_embeddings": 80}


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    # integers with nulls come as floats
    return sorted((tuple(cell(int(v)) if isinstance(v, float) and v == v and v.is_integer() else cell(v) for v in r) for r in frame.values.tolist()), key=lambda r: tuple((x is None, x or "") for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, small, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    if name not in registry.ORACLE:
        # every input row gives rows; what they hold is tested by brute force elsewhere
        assert name in WITHOUT_TWIN and len(got) >= WITHOUT_TWIN[name]
        return
    want = duck.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_most_queries_have_a_twin():
    assert len(registry.ORACLE) >= 0.9 * len(registry.QUERIES)
