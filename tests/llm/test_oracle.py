"""The corpus queries that have SQL, against DuckDB."""

import duckdb
import pytest

from gridlark.llm import queries as Q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    relation = con.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    expected = sorted(tuple(r[relation.columns.index(c)] for c in columns) for r in relation.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == expected and expected


def test_sql_of_odd_texts(spark):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    body = "".join(chr(97 + k * k % 23) for k in range(700))
    rows = [(1, None), (1, ""), (None, body), (4, "é" + body[100:500] + "zz" + body[:250]), (4, "token = abcdefghijklmnop " + "0123abcd" * 4), (9, "x" * 500)]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    from gridlark.llm.suffixes import remove_repeats

    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, found)) == sorted(r[1:4] for r in con.sql(Q.oracle_sql()["op5_suffix_dedup"]).fetchall())
