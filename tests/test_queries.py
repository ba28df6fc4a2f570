"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lynceus.plans.inventory import QUERIES
from lynceus.plans.inventory_sql import ORACLE_SQL as INVENTORY_SQL
from lynceus.plans.oracle import ORACLE_SQL as FIRST_SQL

ORACLE_SQL = {**FIRST_SQL, **INVENTORY_SQL}

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(df, sql):
    names = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(sql)
    assert sorted(want.columns) == names
    rows = [tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall()]
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(repr(plain(r)) for r in got) == sorted(repr(plain(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_trained(spark):
    """What SQL can't say: an exported model scores as its trainer, and trained scores tell labels apart."""
    rows = QUERIES["gbt_train"](spark, SF).collect()
    assert rows and all(r.score == pytest.approx(r.exported, abs=1e-5) for r in rows)
    labels = {r.vec_id: r.label for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()}
    guesses = {r.vec_id: r.prediction for r in QUERIES["emb_lr"](spark, SF).collect()}
    most = max(list(labels.values()).count(v) for v in set(labels.values()))
    assert guesses.keys() == labels.keys() and sum(guesses[k] == v for k, v in labels.items()) >= most
    scored = {r.page_id: r.score for r in QUERIES["char_ngram_lr"](spark, SF).collect()}
    odd = {r.page_id: len(r.url) % 2 for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    one, zero = ([scored[k] for k, v in odd.items() if v == y] for y in (1, 0))
    assert all(0 <= v <= 1 for v in scored.values()) and sum(one) / len(one) > sum(zero) / len(zero)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(ORACLE_SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
