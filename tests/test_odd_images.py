"""Queries of image rows on odd documents equal their SQL: texts that are empty or null, ids that are null or occur more than once."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pelagia import catalog_of_queries as base

SF = "/root/testdata/sf0.001"
DARK, BRIGHT = "\x01" * 16, "zz" * 8
#: What is added to the first 30 documents: text and id.
ODD = {
    "empty": [("", 1000), ("", 1001), (None, 1002), ("a", 1003)],
    "no id": [("abc" * 60, None), (DARK * 30 + BRIGHT * 9, None), ("", None), (None, None)],
    "one without id": [(DARK + BRIGHT * 5 + DARK + BRIGHT, None)],
    "repeated": [("ABCabc" * 400, 3), ("short", 3), (DARK * 1100, 4), ("", 4), ("", 5), ("", 1000), ("", 1000), (None, 1001), ("tiny", 1001), ("ab", 1001), ("cd" * 99, 1001)],
}


@pytest.fixture(params=sorted(ODD))
def folder(request, tmp_path):
    docs = pq.read_table(f"{SF}/documents.parquet").slice(0, 30)
    more = [{"doc_id": i, "text": t, "lang": "en", "source": "odd", "n_chars": len(t or "")} for t, i in ODD[request.param]]
    pq.write_table(pa.concat_tables([docs, pa.Table.from_pylist(more, docs.schema)]), tmp_path / "documents.parquet")
    return os.fspath(tmp_path)


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got, want = base.queries()[name](spark, folder).toArrow(), con.sql(base.oracle_sql()[name]).to_arrow_table()
    rows = lambda t: sorted(str([r[c] for c in sorted(want.column_names)]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_medians_of_places(spark, folder):
    same(spark, folder, "ag_pixel_median")


def test_random_patches(spark, folder):
    same(spark, folder, "flt_random_patch")


def test_edge_scans(spark, folder):
    same(spark, folder, "wn_edge_scan")
