"""The driver's contract, and queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["F1_split_claims", "P2_apply_patches", "A5_assemble_checks", "W8_claim_segments", "J11_fill_answers", "C1_ingest", "C1_ingest_archives", "C1_ingest_failed", "F1_to_F5_in_sql", "C11_run_evals", "T2_stream_dedupe", "T8_stream_dead_letters"])
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    as_text = lambda rows: sorted(repr(tuple(list(x) if isinstance(x, list | tuple) else x for x in r)) for r in rows)
    assert as_text(tuple(r[c] for c in names) for r in df.collect()) == as_text(got.fetchall())
