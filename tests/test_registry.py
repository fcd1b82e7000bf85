"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from registry.queries import REGISTRY, Query
from tools.verify import TABLES, key, same

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", REGISTRY)
def test_query_matches_its_twin(spark, sql, name):
    query = REGISTRY[name]
    columns = sorted(n for n, _ in query.columns)
    frame = query.run(spark, FOLDER).select(*[f"`{c}`" for c in columns])
    got = sorted((tuple(r) for r in frame.collect()), key=key)
    if query.sql is None:
        assert got
        return
    listed = ", ".join(f'"{c}"' for c in columns)
    want = sorted(sql.execute(f"select {listed} from ({query.oracle()}) t").fetchall(), key=key)
    assert len(got) == len(want)
    assert all(same(a, b) for a, b in zip(got, want))


def test_whole_numbers_past_64_bits_keep_their_digits(spark):
    columns = (("source", "s"), ("small", "w"), ("large", "w"))

    def build(_):
        return spark.sql(
            "select 'a' as source, cast(7 as decimal(38,0)) as small,"
            " cast('836551737674068770840' as decimal(38,0)) as large"
        )

    frame = Query("wide", columns, build, None).run(spark, FOLDER)
    assert dict(frame.dtypes)["small"] == "bigint"
    assert tuple(frame.first()) == ("a", 7, 836551737674068770840)
