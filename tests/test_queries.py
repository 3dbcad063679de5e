"""Every registered query against its SQL, over whole tables."""

import pytest
from check import compare, connect

import __spark_entry__ as entry
from muster.suite.oracle import oracle
from muster.suite.queries import queries

SQL = oracle()
QUERIES = queries()
UNCHECKED: set[str] = set()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == UNCHECKED
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, duck, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), duck, SQL[name]) is None


def test_inputs_reach_every_outcome(duck):
    duck = connect("/root/testdata/sf0.01")
    verdicts = {row[0] for row in duck.execute(f"SELECT DISTINCT verdict FROM ({SQL['page_verdict']})").fetchall()}
    assert verdicts == {"unknown_count", "missing_id_list", "empty_page", "gap", "overlap", "incomplete", "ok"}
    outcomes = {row[0] for row in duck.execute(f"SELECT DISTINCT outcome FROM ({SQL['resolve_requests']})").fetchall()}
    assert outcomes == {"invalid_mode", "reuse", "no_latest", "no_manifest", "no_ids", "email_required", "create"}
    assert duck.execute(f"SELECT count(*) FROM ({SQL['snapshot_collisions']})").fetchone()[0] > 0
    retries = {row[0] for row in duck.execute(f"SELECT DISTINCT outcome FROM ({SQL['retry_outcome']})").fetchall()}
    assert {"succeeded", "exhausted"} <= retries


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0



def test_a_file_is_not_its_list(spark, sf_dir):
    rows = QUERIES["file_digest"](spark, sf_dir).collect()
    assert rows and all(r.sha256 != r.ids_sha256 for r in rows)
