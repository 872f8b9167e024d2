"""The registered corpus queries on the smallest tables."""

import duckdb
import pytest

from kinweave.llm import queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    1: "page_id url text n_chars", 2: "doc_id n_lines n_dropped kept_sha256", 3: "doc_id n_bytes n_removed n_spans kept_sha256", 4: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    6: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 8: "doc_id fingerprint n_near component_id", 9: "page_id host path rule verdict", 10: "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("n", range(1, 11))
def test_columns_and_rows(spark, n):
    name = next(k for k in queries.queries() if k.startswith(f"op{n}_"))
    out = queries.queries()[name](spark, SMALL)
    assert set(COLUMNS.get(n, "doc_id").split()) <= set(out.columns)
    table = "pages" if n in (1, 9) else "documents"
    assert out.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op2_line_dedup", "base_of_op6", "base_of_op9", "base_of_op10"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(tuple(map(str, r)) for r in x)
    assert rows(got.select(*want.columns).collect()) == rows(want.fetchall())
