import duckdb
import pytest

import __spark_entry__ as entry
from wardline import catalog
from wardline.operators import classifier
from wardline.sources import adapters

TABLES = "events documents pages labels conversations benchmark embeddings".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "~" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, sf)
    want = con.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


def test_classifier_learns(spark, sf):
    samples = adapters.labelled(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    model = classifier.train(samples, features=1 << 10)
    assert classifier.score(samples, model).where("score between 0 and 1").count() == samples.count()


def test_adapters(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "c"), (3, 1, "system", "d")], "conv_id int, turn int, role string, text string")
    assert {r["text"] for r in adapters.graph_state(df).collect()} == {"b", "c", "d"}
    assert [r["text"] for r in adapters.chat_request(df).collect()] == ["c"]
    assert {(r["direction"], r["text"]) for r in adapters.as_messages(df, session="conv_id", order="turn", text="text", role="role").collect()} == {("input", "a"), ("output", "b"), ("input", "c")}
    crew = spark.createDataFrame([('{"task":"t","input":"i"}',), ('{"query":1,"topic":"x"}',), ("[]",), (None,), ("no json",)], "j string")
    assert [r[0] for r in crew.select(adapters.crew_inputs(F.col("j"))).collect()] == ["i", "x", None, None, None]
