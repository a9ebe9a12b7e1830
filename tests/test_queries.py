"""Every query of the engine against its SQL at the smallest scale; the others must run."""

from __future__ import annotations

import duckdb
import pytest

from prefforge.plans import catalog
from tests.oracle import SMALL, connect, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert len(df.collect()) > 0


@pytest.mark.parametrize("name", ["snk_csv", "snk_tsv", "src_csv", "src_tsv"])
def test_files_of_odd_texts(spark, tmp_path, name):
    """Texts that files could take for others: empty, missing, with NUL characters, quotes, separators or line breaks."""
    odd = ["", None, "\\N", "\\\\N", "\0", "a\0\nb", '"\0"', " ", "\t", "\r\n", ",", '""', "plain"]
    rows = [(i, x, odd[(i * 5 + 1) % len(odd)]) for i, x in enumerate(odd * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/t/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/t/documents.parquet/*.parquet')")
    same(QUERIES[name](spark, f"{tmp_path}/t"), con, SQL[name])
