"""Registered queries against their SQL, on the smallest tables; all entries are well formed."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folio.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, sql, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    found = sql.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == expected


def test_normalized_terms_equal_sql_where_capitals_change_letters(spark, tmp_path):
    """SS, which is no repeat of ß, stands in the source too; so with other letters whose capitals lower-case to something else, and a Σ at a word's end."""
    texts = ["Erß verß erss", "ß ssa", "Maße MASSE Maẞe", "\ufb01x fix FIX", "µm μm", "ſo so", "ıx ix", "ΟΔΟΣ\u2019Α", "ασ ας", "İx i̇x", "Plain plain", "", None]
    rows = [(10 * i + k, v) for i, v in enumerate(texts) for k in (0, 1, 2, 3, 4)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(catalogue.ORACLES["normalize_responses"])
    names = [c[0] for c in found.description]
    expected = sorted((plain(r) for r in found.fetchall()), key=repr)
    got = catalogue.QUERIES["normalize_responses"](spark, str(tmp_path)).select(*names).collect()
    assert sorted((tuple(plain(r[c]) for c in names) for r in got), key=repr) == expected and len(got) == 2 * len(texts)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
