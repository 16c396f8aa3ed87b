"""Every registered query against its SQL in an independent engine."""

import math
import os

import duckdb
import pytest

from marlstone.plans import case_queries, place_queries, record_queries, review_queries, rule_queries, signal_queries  # noqa: F401  (register their queries)
from marlstone.plans.queries import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows_of(cols, rows):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, df.collect())
    if name in ORACLE:
        out = duck.execute(ORACLE[name])
        assert got == rows_of([d[0] for d in out.description], out.fetchall())


def test_redaction_of_odd_texts(spark, duck, tmp_path):
    """Nulls, letters of other scripts and vertical tabs beside hits, letters that fold to ASCII, and hits that abut."""
    texts = [None, "", "éC:\\a", "josé.x@y.org éa@b.org", "@josé", "x:/y\x0b/home/z", "to\u212aen=abcdefgh1", "\u017fecret=abcdefgh1", "Ktoken: abcdefgh1", "@user@other", "12345678(02) 1234567", "12345678 +20 12345678", "1234567-12-345-6789", "30.12345, 31.23456, 30.12345,31.23456\n"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {r["doc_id"]: (r["redacted_sha256"], r["changed"]) for r in QUERIES["redact_text"](spark, str(tmp_path)).collect()}
    sql = ORACLE["redact_text"].replace("from documents", f"from '{path}/*.parquet'")
    assert got == {r[0]: r[1:] for r in duck.execute(sql).fetchall()}
