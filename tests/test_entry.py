import decimal
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return format(float(value) + 0.0, ".6g")
    return str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda found: sorted("|".join(map(plain, row)) for row in found)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())


def test_locations_of_odd_texts_against_sql(spark, tmp_path):
    import duckdb

    texts = [None, "", " ", "LAGOS abuja", "IND\u0130A mumbai", "M\u0130DDLE EAST gulf", "usa\x00texas", "plain"]
    sources = ["src1", None, "BBC", "\u0130ndependent"]
    docs = [(15 * i + k, text, "en", source, len(text or "")) for i, (text, source) in enumerate((t, s) for t in texts for s in sources) for k in range(15)]
    docs += [(None, "", "en", "CNN", 0), (-1, None, "en", "CNN", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (7, None, 1)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["x16_classify_location"]).fetchall()
    got = entry.queries()["x16_classify_location"](spark, str(tmp_path)).select("entry_id", "label", "confidence").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) == len(docs)
