"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


# These repeat a model that another query checks; set RUN_SLOW to include them.
SLOW = {"walk_recommend_corrected", "eval_walk", "als_curve", "eval_item_cf", "rule_recommend_corrected"}
SLOW |= {"eval_item_cf_mean_shift", "eval_rules_mean_shift", "rule_recommend_mean_shift"}
SLOW |= {"eval_svd", "eval_w2v", "svd_recommend_corrected", "item_cf_mean_shift", "eval_cbow"}


def fast(names):
    """Without the slow ones and the text operators, which have their own tests."""
    return [n for n in names if (n not in SLOW or os.environ.get("RUN_SLOW")) and n != "pipeline" and not n.startswith("op")]


@pytest.mark.parametrize("name", fast(oracle_sql()))
def test_same_rows(spark, con, name):
    df = queries()[name](spark, FOLDER)
    result = con.execute(oracle_sql()[name])
    want = table([d[0] for d in result.description], result.fetchall())
    assert table(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", fast(sorted(set(queries()) - set(oracle_sql()))))
def test_lists_hold_their_rules(spark, name):
    """Queries without SQL: ranks run from 1, scores fall, no item twice, at most ten."""
    df = queries()[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if not {"user_id", "rank", "item_id", "score"} <= set(df.columns):
        return
    users = {}
    for r in sorted(rows, key=lambda r: (r["user_id"], r["rank"])):
        users.setdefault(r["user_id"], []).append(r)
    for found in users.values():
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) <= 10
        assert len({r["item_id"] for r in found}) == len(found)
        order = [(-r["score"], r["item_id"]) for r in found]
        assert order == sorted(order)


def test_entry(spark):
    row = entry(spark).collect()
    assert len(row) == 1 and row[0]["hits"] > 0
