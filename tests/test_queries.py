"""Every query of the engine's own operators against its SQL."""

import pytest
from tests.compare import connect, same

from foliograph.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(registry.queries()[name](spark, sf), con, SQL[name])


def test_newlines_of_all_rows(spark, tmp_path):
    rows = [(0, "a\r\nb\r\nc"), (3, "a\rb"), (6, "a\nb"), (9, "a"), (1, "a\nb"), (2, "a\nb")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["newline_normalise"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "a b c", "CRLF"), (1, "a b", "CRLF"), (2, "a b", "CR"), (3, "a b", "CR"), (6, "a b", "LF"), (9, "a", "LF")]


def test_short_copies_are_pairs(spark, tmp_path):
    rows = [(1, "one two"), (2, "One, two!"), (3, "one two three"), (4, ""), (5, ""), (6, "a b c d e"), (7, "a b c d e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["class"] for r in registry.queries()["jaccard_classes"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 6: 6, 7: 6} and registry.queries()["jaccard_pairs"](spark, str(tmp_path)).count() == 0


def test_markers_that_follow_themselves(spark, tmp_path):
    from foliograph.operators import workflow

    texts = ["in the in the in the", "In the  in the, in the\nin the", "of the in the of the", "und der und der der", "the the not not", "within the in them in_the", "\ue000 x\x00the|que", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()["marker_counts"](spark, str(tmp_path))
    same(got, con, SQL["marker_counts"])
    assert {tuple(r) for r in got.collect()} >= {(0, "in the", 2), (0, "the", 1), (1, "in the", 4), (2, "of the", 2), (2, "in the", 1), (3, "und der", 1), (3, "der", 2)}
    shared = workflow.marker_counts(docs, "doc_id", "text", ["the", "in the", "within the"]).filter("doc_id IN (0, 5)")
    assert {tuple(r) for r in shared.collect()} == {(0, "in the", 3), (5, "within the", 1)}


def test_entry_runs_and_names_match(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
