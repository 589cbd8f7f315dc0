import math
import os

import __spark_entry__ as entry
import duckdb
import pytest
from loomtext.plans.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    clean = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    ours = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(ours.columns)
    theirs, mine = plain(found.fetchall()), plain(map(tuple, ours.select(*[f"`{n}`" for n in names]).collect()))
    assert len(mine) == len(theirs) and mine == theirs, [x for x in zip(mine, theirs, strict=False) if x[0] != x[1]][:3]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "turn", "chunk_id", "overlap", "rn"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
