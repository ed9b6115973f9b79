"""Every registered query of the library against its oracle, at the smallest scale."""

import math
import os

import duckdb
import pytest

from postura import estate
from postura.plans import config, evidence, graphs, rules  # noqa: F401  these register their queries
from postura.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return db


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, database, name):
    got = QUERIES[name](spark, SF)
    want = database.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


#: How often a query reads the lines at most: for the call graph, for the occurrences, and for links of dependencies.
PASSES = {"call_resolution": 1, "reach_depth": 1, "backward_relevance": 1, "exposure": 2, "exposure_path": 2, "reachable_assets": 2, "graph_stats": 1, "graph_totals": 1, "exposed_priority": 2, "confirmed_liveness": 2, "graph_edges": 2, "graph_network": 2, "graph_integrity": 2, "asset_lineage": 2, "dependency_expand": 1}


@pytest.mark.parametrize("name", PASSES)
def test_lines_are_joined_once_for_each_use(spark, monkeypatch, name):
    read, rows = estate.read, spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    monkeypatch.setattr(estate, "read", lambda s, d, table: read(s, d, table).mapInArrow(counted, read(s, d, table).schema) if table == "lineitem" else read(s, d, table))
    QUERIES[name](spark, SF).count()
    assert 0 < rows.value <= PASSES[name] * read(spark, SF, "lineitem").count()
