import duckdb
import pytest

from plumbline.plans import driver_queries as q

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["speaker_path", "speaker_cycles", "speaker_reach", "ratchet_lines"])
def test_rows_equal_sql_over_whole_tables(spark, name):
    duck = duckdb.connect()
    for t in ("conversations", "lineitem", "supplier"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    want = duck.execute(q.ORACLE_SQL[name])
    columns, rows = [c[0] for c in want.description], want.fetchall()
    assert rows and "%" not in q.ORACLE_SQL[name]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in q.QUERIES[name](spark, D).select(columns).collect())


def test_every_conversation_reaches_the_graph(spark):
    convs = {r.conv_id for r in q.table(spark, D, "conversations").select("conv_id").collect()}
    assert {int(r.node.split(":")[0]) for r in q.speaker_path(spark, D).collect()} == convs
