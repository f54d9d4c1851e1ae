"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from tidemark.plans import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    if name not in engine.oracle_sql():
        assert got
        return
    cursor = duck.execute(engine.oracle_sql()[name])
    own = [d[0] for d in cursor.description]
    assert sorted(own) == names
    wanted = sorted(str([plain(dict(zip(own, row, strict=True))[n]) for n in names]) for row in cursor.fetchall())
    assert got == wanted


@pytest.mark.parametrize("name", ["files_by_format", "text_files_documents", "text_files_chunked"])
def test_files_of_odd_documents(spark, tmp_path, name):
    """Empty and null texts, names that no folder can have, and no documents at all."""
    odd = [(1, "some text\n\nmore", "en", "a"), (2, "", "en", "a"), (3, None, "en", "b"), (4, " \n\n ", "de", "_x"), (5, "x", ".", ".."), (6, "dots", ".h", "a/b"), (7, "", "", ""), (8, "n", "fr", None), (9, "m", None, "s"), (-10, "l", "a%b", "c d"), (None, "k", "en", "a")]
    for i, rows in enumerate((odd, odd[:0])):
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        d.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        got = engine.queries()[name](spark, f"{tmp_path}/{i}")
        with duckdb.connect() as c:
            c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
            if rows:
                c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
            cursor = c.execute(engine.oracle_sql()[name])
            names = [x[0] for x in cursor.description]
            assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))
