"""Every catalog query against its SQL, and the driver contract."""

import importlib
import math
import sys

import pytest

import __spark_entry__
from astroloom import catalog_queries

from .conftest import DATA

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in catalog_queries.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog_queries.SQL))
def test_query(spark, duck, name):
    got = catalog_queries.QUERIES[name](spark, str(DATA)).toArrow()
    columns = sorted(got.column_names)
    expected = duck.sql(catalog_queries.SQL[name])
    assert sorted(expected.columns) == columns
    rows = expected.fetchall()
    at = [expected.columns.index(c) for c in columns]
    ours = zip(*[got.column(c).to_pylist() for c in columns], strict=True)
    assert sorted(tuple(map(plain, r)) for r in ours) == sorted(tuple(plain(r[i]) for i in at) for r in rows)


def test_registries_do_not_mix(spark):
    """Two registries of one session have tables and a TAP_SCHEMA of their own."""
    from astroloom.engine import Engine
    from astroloom.registry import Registry

    first, second = Registry(spark), Registry(spark)
    for r, n in ((first, 1), (second, 2)):
        r.add_frame("a.t", spark.range(n).withColumnRenamed("id", f"c{n}"))
        r.publish_schema()
    for r, n in ((first, 1), (second, 2)):
        assert Engine(spark, r).run("SELECT * FROM a.t").table.num_rows == n
        names = Engine(spark, r).run("SELECT column_name FROM TAP_SCHEMA.columns WHERE table_name = 'a.t'").table.to_pylist()
        assert names == [{"column_name": f"c{n}"}]


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if __spark_entry__.HAS_TEXT_OPERATORS:
        numbers = [int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
        assert numbers == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


def test_without_the_text_operators(monkeypatch):
    """The contract module imports and works where their folder is gone."""
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("astroloom.llm", "corpus_pipeline") else real(n, *a))
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(catalog_queries.QUERIES)
    monkeypatch.undo()


def test_links_of_all_planes(spark):
    """The ids stay a frame, and no plane is left out; a request has its own ids only."""
    from astroloom.service import links

    own = catalog_queries.images(spark, str(DATA))
    planes = own.registry.frame("caom.plane")
    assert catalog_queries.QUERIES["datalink_links_all"](spark, str(DATA)).count() == 3 * planes.count() > 60
    plan = links.artifacts_of(own, planes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan
    ids = sorted(r.plane_uri for r in planes.where("t_min < 40").collect())
    reply = links.links(own, [("RESPONSEFORMAT", "csv"), *[("ID", x) for x in ids]])
    lines = reply.body.decode().splitlines()[1:]
    assert len(ids) == 20 and sorted(x.split(",")[0].strip('"') for x in lines) == sorted(ids * 3)
