import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "source", "redacted_text"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    from shroud.plans.queries import all_queries
    assert set(all_queries()) <= set(E.oracle_sql()) <= set(E.queries())  # the optional part names its own exceptions


@pytest.mark.parametrize("key", ["redact_contacts", "find_phones", "bio_spans", "name_map", "redact_documents",
                                 "token_windows"])
def test_oracle_agrees_small(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[key](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    s = sorted(tuple(r[c] for c in cols) for r in sdf.collect())
    rel = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in rel.description]
    d = sorted(tuple(row[names.index(c)] for c in cols) for row in rel.fetchall())
    assert s == d


def test_flagship_scans_only_needed_columns(spark):
    plan = E.queries()["redact_contacts"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan or "struct<doc_id:bigint,text:string>" in plan
    assert "struct<page_id:bigint,url:string>" in plan
    assert "html" not in plan and "n_chars" not in plan
