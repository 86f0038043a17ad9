"""Queries against their SQL twins on odd rows."""

import pytest
from test_queries import plain

import __spark_entry__ as entry

ODD = {
    "feed_items": [
        (0, ". no title", "src1"), (1, "", "src1"), (2, None, "src2"), (3, "\n\nsaid", "src2"), (4, "ends  　", "src2"), (5, "  begins. Said", "src2"),
        (6, "line  . said  ", "src2"), (7, "no source", None), (8, "a name", "a+b/c %20 8"), (-9, "below zero", "src9"), (10, "null", "src1"), (None, "no number", "src3"),
    ],
    "cluster_scope_flags": [(k, f"{front}. Resto {k}", "src1") for k, front in enumerate(["et la treoi", "eet la treoi", "caso. la tal", "x … tio", "um … dia", "nada", "os ates thx", "outra"])],
}


@pytest.mark.parametrize("name", ODD)
def test_twin_on_odd_rows(spark, tmp_path, name):
    import duckdb

    at = str(tmp_path / "documents.parquet")
    rows = spark.createDataFrame([(k, text, source, "pt") for k, text, source in ODD[name]], "doc_id long, text string, source string, lang string")
    rows.coalesce(1).write.parquet(at)
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
